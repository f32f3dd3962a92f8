"""Enrichment and look-up joins."""

import ipaddress
import random

import pytest
from helpers import events, ids
from pyspark.sql import functions as F

from palisade.functions.text import ipv4_number
from palisade.operators import enrich as en
from palisade.operators.enrich import enrich_threats, locate
from palisade.operators.joins import fits_broadcast, lookup_join
from palisade.operators.prefixes import address_bits, with_prefixes


def test_lookup_join_is_the_same_shuffled_and_broadcast(spark):
    big = spark.range(2000).withColumn("k", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50))
    small = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        a = lookup_join(big, small, ["k"], how=how)
        b = lookup_join(big, small, ["k"], how=how, measure=False)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_lookup_join_broadcasts_only_what_is_measured_small(spark, monkeypatch):
    big = spark.range(50).withColumnRenamed("id", "k")
    small = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))

    def plan(**options):
        return lookup_join(big, small, ["k"], **options)._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(how="inner") and "BuildLeft" not in plan(how="inner")
    assert "BroadcastHashJoin" not in plan(how="inner", measure=False)
    monkeypatch.setattr("palisade.operators.joins.fits_broadcast", lambda _: False)
    assert "BroadcastHashJoin" not in plan(how="inner") + plan(how="left")


def test_size_check(spark):
    assert fits_broadcast(spark.range(10)) and not fits_broadcast(spark.range(10), max_rows=9)
    assert not fits_broadcast(spark.range(1).select(F.repeat(F.lit("x"), 1000).alias("s")), max_bytes=500)


@pytest.mark.parametrize("ip,number", [
    ("0.0.0.0", 0), ("1.2.3.4", 16909060), ("255.255.255.255", 4294967295), ("256.1.1.1", None), ("1.2.3", None), ("a.b.c.d", None),
    ("::1", None), (None, None)])
def test_ipv4(spark, ip, number):
    assert spark.range(1).select(ipv4_number(F.lit(ip).cast("string")).alias("n")).first()["n"] == number


def test_geo(spark):
    ranges = spark.createDataFrame([
        ("10.0.0.0", "10.2.255.255", "AA", "Big", 1.0, 2.0, "i", "o"), ("192.0.2.16", "192.0.2.31", "BB", "Small", 3.0, 4.0, "i", "o"),
    ], "start_ip string, end_ip string, country string, city string, latitude double, longitude double, isp string, organization string")
    rows = [dict(eventId="a", ip="10.1.200.7"), dict(eventId="b", ip="192.0.2.31"), dict(eventId="c", ip="192.0.2.32"),
            dict(eventId="d", ip="", sip="10.2.255.255"), dict(eventId="e", ip="fe80::1"), dict(eventId="f", country="US")]
    got = {r["eventId"]: r for r in en.enrich_geo(events(spark, rows), ranges).collect()}
    assert {k: r["enrichment"]["geo_ip"] and r["enrichment"]["geo_ip"]["country"] for k, r in got.items()} == {
        "a": "AA", "b": "BB", "c": "Unknown", "d": "AA", "e": "Unknown", "f": None}
    assert got["a"]["actor"]["geo_location"]["city"] == "Big"
    assert got["d"]["actor"]["geo_location"] is None  # the address was the network's
    assert got["f"]["actor"]["geo_location"]["country"] == "US"
    assert got["c"]["enrichment"]["geo_ip"]["latitude"] == 0.0


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_threats(spark, broadcast_rows):
    rows = [dict(eventId="a", ip="203.0.113.1", sip="192.0.2.1", dip="198.51.100.1", risk=0.2), dict(eventId="b", sip="192.0.2.1"),
            dict(eventId="c", ip="203.0.113.2", risk=0.3), dict(eventId="d", dip="192.0.2.1", risk=0.0), dict(eventId="e", ip="192.0.2.1", risk=0.9)]
    got = {r["eventId"]: r for r in en.enrich_threats(events(spark, rows), en.default_threat_list(spark), broadcast_rows).collect()}
    assert got["a"]["threatIndicators"] == ["malicious_ip:203.0.113.1", "malicious_ip:192.0.2.1", "malicious_ip:198.51.100.1"]
    assert {k: r["risk_score"] for k, r in got.items()} == {"a": 0.4, "b": 1.0, "c": 0.3, "d": 1.0, "e": 1.0}
    assert got["c"]["enrichment"]["threatIntel"]["threat_level"] == "none" and got["c"]["threatIndicators"] == []


def test_assets_and_dns(spark):
    assets = spark.createDataFrame([("r1", "ops", "high", None)], "resource_id string, owner string, criticality string, last_seen timestamp")
    ptr = spark.createDataFrame([("1.1.1.1", "one.example")], "ip string, hostname string")
    rows = [dict(eventId="a", resourceId="r1", ip="1.1.1.1"), dict(eventId="b", resourceId="r2", ip="2.2.2.2"), dict(eventId="c")]
    got = {r["eventId"]: r["enrichment"] for r in en.enrich(events(spark, rows), {"asset_inventory": assets, "dns": ptr}).collect()}
    assert (got["a"]["asset_inventory"]["owner"], got["b"]["asset_inventory"]["criticality"]) == ("ops", "medium")
    assert got["c"]["asset_inventory"] is None
    assert got["a"]["dns"]["hostname"] == "one.example" and got["b"]["dns"] is None


def test_switches(spark):
    df = events(spark, [dict(ip="203.0.113.1")])
    dims = {"threat_intel": en.default_threat_list(spark)}
    assert en.enrich(df, dims).first()["threatIndicators"] and not en.enrich(df, dims, {"threat_intel": False}).first()["threatIndicators"]
    assert ids(en.enrich(df, {})) == ["e00000"]


def test_lookups_never_add_rows(spark):
    rows = [dict(eventId="a", ip="10.1.2.3", resourceId="r"), dict(eventId="b", ip="10.1.2.3", resourceId="r"), dict(eventId="c")]
    ranges = spark.createDataFrame([("10.0.0.0", "10.255.255.255", "Wide"), ("10.1.2.0", "10.1.2.255", "Narrow"), ("10.1.0.0", "10.1.255.255", "Mid")],
                                   "start_ip string, end_ip string, country string").selectExpr(
        "*", *[f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in en.GEO.fields[1:] if f.name != "country"])
    assets = spark.createDataFrame([("r", "old", "low", "2024-01-01"), ("r", "new", "high", "2024-02-01")], "resource_id string, owner string, criticality string, last_seen string")
    ptr = spark.createDataFrame([("10.1.2.3", "b.example.org"), ("10.1.2.3", "a.example.org")], "ip string, hostname string")
    got = en.enrich(events(spark, rows), {"geo_ip": ranges, "asset_inventory": assets, "dns": ptr}).orderBy("eventId").collect()
    assert [r.eventId for r in got] == ["a", "b", "c"]
    for r in got[:2]:
        assert r.enrichment.geo_ip.country == "Narrow" and r.enrichment.asset_inventory.owner == "new" and r.enrichment.dns.hostname == "a.example.org"


def test_address_bits(spark):
    rng = random.Random(1)
    texts = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(50)]
    for _ in range(200):
        value = rng.getrandbits(128) & rng.choice([2**128 - 1, 0xFFFF << 64, 0xFFFF, 0xFFFF_0000_FFFF << 80, 0])
        address = ipaddress.IPv6Address(value)
        texts += [str(address), address.exploded.upper(), str(address).upper()]
    texts += ["::ffff:1.2.3.4", "64:ff9b::192.0.2.33", "1:2:3:4:5:6:7.8.9.10", "::", "1::", "::1"]
    bad = ["", "x", "1.2.3", "1.2.3.256", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "::1.2.3.256", ":1", "1:", "fe80::1%eth0", "1.2.3.4/8", None, ":::", "1:2:3:4:5:6:7:8::"]
    rows = spark.createDataFrame([(t,) for t in texts + bad], "ip string").select("ip", address_bits(F.col("ip")).alias("bits")).collect()
    for r in rows[:len(texts)]:
        address = ipaddress.ip_address(r.ip)
        assert r.bits == f"{address.version}{int(address):0{address.max_prefixlen}b}", r.ip
    assert all(r.bits is None for r in rows[len(texts):])


def test_nested_ranges_against_all(spark):
    """Ranges of both families with any ends, from the whole family to one address; broken ones go."""
    rng, ranges, addresses = random.Random(2), [("0.0.0.0", "255.255.255.255"), ("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff")], []
    for bits, make in ((32, ipaddress.IPv4Address), (128, ipaddress.IPv6Address)):
        base = rng.getrandbits(bits - 12) << 12
        for _ in range(60):
            a, b = sorted((base + rng.randrange(4096), base + rng.choice([rng.randrange(4096), rng.randrange(4096) % 7])))
            ranges.append((str(make(a)), str(make(b))))
        addresses += [str(make(base + rng.randrange(4096))) for _ in range(150)] + [str(make(rng.getrandbits(bits))) for _ in range(10)]
    ranges += [("9.9.9.9", "1.1.1.1"), ("1.1.1.1", "::1"), ("x", "y"), (None, "1.1.1.1"), ("1.1.1.1", None)]
    df = spark.createDataFrame([(*r, f"c{i}", f"c{i}", 0.5, 0.5, "i", "o") for i, r in enumerate(ranges)],
                               "start_ip string, end_ip string, country string, city string, latitude double, longitude double, isp string, organization string")
    prefixed = with_prefixes(df, "start_ip", "end_ip")
    assert max(r["count"] for r in prefixed.groupBy("country").count().collect()) <= 2 * 128
    asked = spark.createDataFrame([(a,) for a in [*addresses, "no address"]], "ip string")
    got = {r.ip: r.geo.country for r in locate(asked, "ip", df).collect()}
    for a in addresses:
        value, fit = ipaddress.ip_address(a), []
        for i, (s, e) in enumerate(ranges[:-5]):
            first, last = ipaddress.ip_address(s), ipaddress.ip_address(e)
            if first.version == value.version and first <= value <= last:
                fit.append((int(last) - int(first), int(first), f"c{i}"))
        width, first, _ = min(fit)
        assert got[a] in {c for w, f, c in fit if (w, f) == (width, first)}
    assert got["no address"] == "Unknown"


@pytest.mark.parametrize("broadcast_rows", [200_000, 1])
def test_threat_networks(spark, broadcast_rows):
    rows = [dict(ip="10.1.2.3", sip="10.1.2.4", dip="10.9.9.9"), dict(ip="2001:DB8::5", sip="10.1.2.3"), dict(ip="nothing", sip="")]
    listed = spark.createDataFrame([("10.1.0.0/16", "wide"), ("10.1.2.0/29", "near"), ("10.1.2.3", "exact"), ("2001:db8::/32", "six"), ("bad/99", "bad"), (None, "none"), ("", "empty")],
                                   "ip string, feed string")
    got = [(r.i.indicators_found, r.i.sources) for r in enrich_threats(events(spark, rows), listed, broadcast_rows).orderBy("eventId").selectExpr("enrichment.threatIntel AS i").collect()]
    assert got == [(["10.1.2.3", "10.1.2.4"], ["exact", "near"]), (["2001:DB8::5", "10.1.2.3"], ["six", "exact"]), ([], [])]
