"""Enrichment as independent left look-ups; each can be switched on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import first_nonempty, lookup_ip
from palisade.operators.joins import BROADCAST_ROWS, fits_broadcast, lookup_join
from palisade.operators.prefixes import match, with_prefixes
from palisade.schema import ENRICHMENT, GEO, typed_struct
from palisade.session import land

# The default threat list, placeholders, and the risk rule for a hit.
DEFAULT_THREAT_IPS = ["192.0.2.1", "198.51.100.1", "203.0.113.1"]
DEFAULT_FEED = "threat_feed_placeholder"
UNKNOWN = "Unknown"
DEFAULT_CRITICALITY = "medium"
DEFAULT_RISK, RISK_FACTOR, RISK_CAP = 0.5, 2.0, 1.0


def locate(rows: DataFrame, ip: str, ranges: DataFrame) -> DataFrame:
    """Add the ``geo`` struct of the address column ``ip`` (placeholders where no range holds it).

    ``ranges``: start_ip, end_ip and the fields of the location, IPv4 or IPv6. Distinct addresses are located first, so a
    busy address repeats neither the match nor its shuffle. Of overlapping ranges the narrowest holds, of equally narrow
    ones the first, so no row is ever multiplied."""
    distinct = rows.select(ip).where(F.col(ip).isNotNull()).distinct()
    located = land(_match_ranges(distinct, ip, land(with_prefixes(ranges, "start_ip", "end_ip"))))
    return lookup_join(rows, located, [ip])


def _match_ranges(addresses: DataFrame, ip: str, side: DataFrame) -> DataFrame:
    """One row per address with its ``geo``."""
    joined = match(addresses, ip, side, "left")
    found = [F.col(ip).alias("ip")]
    for field in GEO.fields[1:]:
        fallback = F.lit(0.0) if field.name in ("latitude", "longitude") else F.lit(UNKNOWN)
        found.append(F.coalesce(F.col(field.name), fallback).cast(field.dataType).alias(field.name))
    choice = F.struct(F.coalesce("width", F.lit("~")).alias("width"), "first", F.struct(*found).alias("geo"))  # "~": after all digits
    return joined.groupBy(ip).agg(F.min(choice).alias("__best")).select(ip, F.col("__best.geo").alias("geo"))


def enrich_geo(events: DataFrame, ranges: DataFrame) -> DataFrame:
    """Fill ``enrichment.geo_ip`` and, when the address is the actor's, the actor's location."""
    joined = locate(events.withColumn("__ip", lookup_ip()), "__ip", ranges)
    own = first_nonempty(F.col("actor.ipAddress")).isNotNull()
    return (
        joined.withColumn("enrichment", _set_enrichment("geo_ip", F.col("geo")))
        .withColumn("actor", F.when(own, F.col("actor").withField("geo_location", F.col("geo")))
                    .otherwise(F.col("actor")))
        .drop("__ip", "geo")
    )


def _set_enrichment(key: str, value: Column) -> Column:
    fields = {f.name: F.col(f"enrichment.{f.name}") for f in ENRICHMENT.fields}
    fields[key] = value
    return typed_struct(fields, ENRICHMENT)


def default_threat_list(spark) -> DataFrame:
    return spark.createDataFrame([(ip, DEFAULT_FEED) for ip in DEFAULT_THREAT_IPS], "ip string, feed string")


def enrich_threats(events: DataFrame, threat_ips: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Match actor, network source and network destination, in that order, against the list.

    An entry is an address or a network in CIDR form. Networks are looked up by the distinct addresses of the events,
    and what they hold joins the list as addresses; an entry for the address itself comes before its networks, a
    narrower network before a wider one."""
    slots = {"__a": "actor.ipAddress", "__s": "network.sourceIp", "__d": "network.destinationIp"}
    is_network = F.col("ip").contains("/")
    feeds = threat_ips.where(~is_network).groupBy("ip").agg(F.min("feed").alias("feed"))
    networks = threat_ips.where(is_network).select(F.col("ip").alias("network"), "feed")
    small = fits_broadcast(feeds, broadcast_rows)
    has_networks = not networks.isEmpty()
    if not small or has_networks:
        seen = events.select(F.explode(F.array(*[F.col(p) for p in slots.values()])).alias("ip")).where("ip <> ''").distinct()
        if has_networks:
            seen = land(seen)
        if not small:  # keep only the listed addresses that occur at all
            feeds = feeds.join(seen, "ip", "left_semi")
        if has_networks:
            held = match(seen, "ip", land(with_prefixes(networks, "network"))).groupBy("ip").agg(F.min_by("feed", F.struct("width", "feed")).alias("feed"))
            feeds = feeds.unionByName(held.join(feeds.select("ip"), "ip", "left_anti"))
        feeds = land(feeds)
        small = fits_broadcast(feeds, broadcast_rows)
    for name, path in slots.items():
        events = events.withColumn(name, F.nullif(F.col(path), F.lit("")))
        side = feeds.select(F.col("ip").alias(name), F.col("feed").alias(f"{name}_feed"))
        events = lookup_join(events, F.broadcast(side) if small else side, [name], measure=False)
    hits = F.array_compact(F.array(*[F.when(F.col(f"{n}_feed").isNotNull(), F.col(n)) for n in slots]))
    feeds_hit = F.array_compact(F.array(*[F.col(f"{n}_feed") for n in slots]))
    level = F.when(F.size("__hits") > 0, "high").otherwise("none")
    intel = F.struct(F.col("__hits").alias("indicators_found"), level.alias("threat_level"),
                     F.col("__feeds").alias("sources"))
    marks = F.transform("__hits", lambda ip: F.concat(F.lit("malicious_ip:"), ip))
    base = F.when(F.coalesce(F.col("risk_score"), F.lit(0.0)) == 0.0, F.lit(DEFAULT_RISK)).otherwise(F.col("risk_score"))
    raised = F.least(base * F.lit(RISK_FACTOR), F.lit(RISK_CAP))
    return (
        events.withColumn("__hits", hits).withColumn("__feeds", feeds_hit)
        .withColumn("enrichment", _set_enrichment("threatIntel", intel))
        .withColumn("threatIndicators", F.concat("threatIndicators", marks))
        .withColumn("risk_score", F.when(F.size("__hits") > 0, raised).otherwise(F.col("risk_score")))
        .drop("__hits", "__feeds", *slots, *[f"{n}_feed" for n in slots])
    )


def enrich_assets(events: DataFrame, assets: DataFrame) -> DataFrame:
    """``assets``: resource_id, owner, criticality, last_seen. Of several rows of a resource the one seen last holds
    (among equals the greatest), so no event is multiplied."""
    fields = ["last_seen", "owner", "criticality"]
    latest = assets.groupBy("resource_id").agg(F.max(F.struct(*fields)).alias("a")).select("resource_id", "a.*")
    side = latest.select(
        F.col("resource_id").alias("__rid"), F.col("owner").alias("__owner"),
        F.col("criticality").alias("__criticality"), F.col("last_seen").alias("__last_seen"))
    joined = lookup_join(events.withColumn("__rid", F.col("resource.resourceId")), side, ["__rid"])
    entry = F.struct(
        F.col("__rid").alias("resource_id"),
        F.coalesce("__owner", F.lit(UNKNOWN)).alias("owner"),
        F.coalesce("__criticality", F.lit(DEFAULT_CRITICALITY)).alias("criticality"),
        F.col("resource.tags").alias("tags"),
        F.col("__last_seen").cast("timestamp").alias("last_seen"),
    )
    return joined.withColumn(
        "enrichment", _set_enrichment("asset_inventory", F.when(F.col("resource").isNotNull(), entry))
    ).drop("__rid", "__owner", "__criticality", "__last_seen")


def enrich_dns(events: DataFrame, ptr: DataFrame) -> DataFrame:
    """``ptr``: ip, hostname – a landed reverse-DNS table. Of several names of an address the first in order holds."""
    side = ptr.groupBy("ip").agg(F.min("hostname").alias("host")).select(F.col("ip").alias("__ip"), F.col("host").alias("__host"))
    joined = lookup_join(events.withColumn("__ip", lookup_ip()), side, ["__ip"])
    entry = F.when(F.col("__host").isNotNull(), F.struct(F.col("__ip").alias("ip"), F.col("__host").alias("hostname")))
    return joined.withColumn("enrichment", _set_enrichment("dns", entry)).drop("__ip", "__host")


def enrich(events: DataFrame, dimensions: dict[str, DataFrame], switches: dict[str, bool] | None = None) -> DataFrame:
    """Apply the enrichments that are switched on and have a table; reverse DNS is always on."""
    switches = {"geo_ip": True, "threat_intel": True, "asset_inventory": True, **(switches or {})}
    steps = [("geo_ip", enrich_geo), ("threat_intel", enrich_threats), ("asset_inventory", enrich_assets)]
    for name, step in steps:
        if switches[name] and name in dimensions:
            events = step(events, dimensions[name])
    return enrich_dns(events, dimensions["dns"]) if "dns" in dimensions else events
