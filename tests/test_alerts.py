"""Fusion, alerts, de-duplication and throttling."""

import logging
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from helpers import events
from pyspark.sql import functions as F

from palisade.operators import dedup as dedup_module
from palisade.operators import throttle as throttle_module
from palisade.operators.alerts import alert_severity, build_alerts, fingerprint
from palisade.operators.anomaly import with_anomaly
from palisade.operators.dedup import alert_groups, deduplicate
from palisade.operators.fusion import overall_score
from palisade.operators.payloads import alert_markdown, payloads, register_channel, route, with_occurrences, write_payloads
from palisade.operators.rules import load_rules
from palisade.operators.throttle import outcomes, passing_instants, taken, throttle
from palisade.plans.detection import detect

DAY = datetime(2024, 1, 1)
WINDOW = 60_000_000


def alert_rows(spark, rows):
    return spark.createDataFrame(rows, "alertId string, fingerprint string, timestamp timestamp")


def at(seconds):
    return DAY + timedelta(microseconds=round(seconds * 1_000_000))


@pytest.mark.parametrize("scores,expected", [
    ([0.3], 0.3), ([0.4], 0.4), ([0.5], 0.5), ([0.6], 0.6), ([0.7], 0.7), ([0.8], 0.8), ([1.0], 1.0),
    ([1.0, 0.7], 0.94), ([1.0, 0.3], 0.86), ([0.8, 0.3], 0.7), ([], 0.0),
])
def test_overall_score(spark, scores, expected):
    column = F.array(*[F.lit(s) for s in scores]).cast("array<double>")
    got = spark.range(1).select(overall_score(column).alias("s")).first()["s"]
    assert got == expected if len(scores) == 1 else abs(got - expected) < 1e-12


def test_severity_bands(spark):
    none = F.expr("CAST(array() AS array<struct<severity:string>>)")
    for score, expected in [(0.9, "critical"), (0.89, "high"), (0.7, "high"), (0.5, "medium"), (0.3, "low"), (0.29, "info")]:
        assert spark.range(1).select(alert_severity(none, F.lit(score)).alias("s")).first()["s"] == expected
    mixed = F.expr("array(named_struct('severity', 'odd'), named_struct('severity', 'medium'), named_struct('severity', 'high'))")
    assert spark.range(1).select(alert_severity(mixed, F.lit(0.0)).alias("s")).first()["s"] == "high"


def test_fingerprint_ignores_who_and_order(spark):
    def mark(indicators, methods):
        return spark.range(1).select(fingerprint(
            F.lit("t"), F.lit("high"), F.array(*[F.lit(m) for m in methods]),
            F.array(*[F.lit(i) for i in indicators])).alias("f")).first()["f"]
    assert mark(["b", "a"], ["rules", "heuristic"]) == mark(["a", "b"], ["heuristic", "rules"])
    assert mark(list("abcdef"), ["rules"]) == mark(list("abcdeg"), ["rules"])  # only the first five count
    assert mark(["a"], ["rules"]) != mark(["b"], ["rules"])
    assert len(mark(["a"], ["rules"])) == 16


def test_alert_texts(spark):
    rows = [dict(eventId="x1", eventName="CreateAccessKey", eventType="configuration_change", username="root", userType="Root", ip="1.2.3.4")]
    df = events(spark, rows, datetime(2024, 11, 16, 3, 15, 22))  # a Saturday night
    alert = build_alerts(detect(df, load_rules(), history=False)).first()
    assert alert["alertId"] == "alert_x1_1731726922" and alert["title"] == "Suspicious Root Account Activity"
    assert alert["severity"] == "critical" and alert["detectionMethods"] == ["rules", "heuristic"]
    assert abs(alert["metadata"]["overallScore"] - 0.94) < 1e-12
    assert alert["description"].split("\n")[-5:] == [
        "**Event:** CreateAccessKey", "**Source:** aws/cloudtrail", "**Time:** 2024-11-16 03:15:22 UTC", "**Actor:** root",
        "**IP Address:** 1.2.3.4"]
    assert alert["indicators"] == sorted(alert["indicators"]) and len(alert["indicators"]) == 4


def test_disabled_and_untrained_anomaly(spark):
    df = events(spark, [dict()])
    assert with_anomaly(df, None).first()["anomaly"].asDict() == {"isAnomaly": False, "score": 0.0, "reasons": ["Model not yet trained"]}
    assert with_anomaly(df, None, enabled=False).first()["anomaly"]["reasons"] == []


def brute_dedup(rows, window_us=WINDOW, opened=None):
    last, out = dict(opened or {}), {}
    for name, mark, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if mark in last and t - last[mark] < timedelta(microseconds=window_us):
            out[name] = (True, last[mark])
        else:
            last[mark] = t
            out[name] = (False, t)
    return out


def test_dedup_is_anchored(spark):
    hour = 3_600_000_000
    rows = [(f"a{i}", "f", at(m * 60)) for i, m in enumerate([0, 10, 59, 60, 61, 130, 190])]
    got = deduplicate(alert_rows(spark, rows), hour)
    kept = sorted(r["timestamp"] for r in got.where("not duplicate").collect())
    assert kept == [at(0), at(3600), at(130 * 60), at(190 * 60)]
    groups = {r["anchor"]: r["occurrenceCount"] for r in alert_groups(got).collect()}
    assert groups == {at(0): 3, at(3600): 2, at(130 * 60): 1, at(190 * 60): 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_dedup_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"id{i:04d}", rng.choice("aaaab" + "cdef" * (seed - 1)), at(rng.choice([rng.random() * 1500, rng.randrange(1500)])))
            for i in range(700)]
    got = deduplicate(alert_rows(spark, rows), WINDOW).collect()
    assert {r["alertId"]: (r["duplicate"], r["anchor"]) for r in got} == brute_dedup(rows)


@pytest.mark.parametrize("fold,run", [(0, 1), (0, 5), (40, 3), (10**6, 1024)])
def test_dedup_by_either_way(spark, monkeypatch, fold, run):
    """Fingerprints of one instant up to hundreds: folded, doubled, or some of each, with the same result."""
    monkeypatch.setattr(dedup_module, "FOLD", fold)
    monkeypatch.setattr(dedup_module, "RUN", run)
    rng = random.Random(7)
    rows = [(f"id{i:04d}", rng.choice("aaaaaabbbcd") + rng.choice(["", "", "", str(i)]), at(rng.choice([rng.random() * 9000, rng.randrange(900) * 10]))) for i in range(900)]
    got = deduplicate(alert_rows(spark, rows), WINDOW).collect()
    assert {r["alertId"]: (r["duplicate"], r["anchor"]) for r in got} == brute_dedup(rows)


def test_dedup_with_open_windows(spark):
    rows = [("a1", "f", at(30)), ("a2", "f", at(59.9)), ("a3", "f", at(60)), ("b1", "g", at(1))]
    opened = spark.createDataFrame([("f", at(0))], "fingerprint string, anchor timestamp")
    got = {r["alertId"]: r["duplicate"] for r in deduplicate(alert_rows(spark, rows), WINDOW, opened).collect()}
    assert got == {"a1": True, "a2": True, "a3": False, "b1": False}


def brute_throttle(rows, limit, window_us=WINDOW):
    passed, out = [], {}
    for name, _, t in sorted(rows, key=lambda r: (r[2], r[0])):
        passed = [p for p in passed if p > t - timedelta(microseconds=window_us)]
        out[name] = len(passed) >= limit
        if not out[name]:
            passed.append(t)
    return out


def admit(points, limit, window):
    """The rule itself, in time order."""
    live, out = [], []
    for t, n in points:
        live = [(u, k) for u, k in live if u > t - window]
        take = min(n, limit - sum(k for _, k in live))
        if take > 0:
            live.append((t, take))
            out.append((t, take))
    return out


def test_taken():
    assert taken(np.array([0, 5, 11]), np.array([3, 2, 4]), 4, 10).tolist() == [3, 1, 3]
    rng = random.Random(5)
    for _ in range(300):
        window, limit = rng.randint(1, 30), rng.randint(1, 6)
        times = sorted(rng.sample(range(200), rng.randint(1, 80)))
        points = [(t, rng.randint(1, limit)) for t in times]
        got = taken(np.array(times), np.array([n for _, n in points]), limit, window)
        assert [(t, k) for t, k in zip(times, got.tolist()) if k] == admit(points, limit, window)


@pytest.mark.parametrize("seed,window,limit", [(1, 60, 3), (2, 600, 5), (3, 7, 2), (4, 60_000, 40)])
def test_passing_instants(spark, seed, window, limit):
    """Calm and busy stretches of all lengths, far apart and close together."""
    rng = random.Random(seed)
    points, t = {}, -5000
    for _ in range(1500):
        t += rng.choice([1, 1, 2, window // 3 + 1, window, window + 1, 9 * window]) if rng.random() < 0.3 else rng.randint(1, max(2, window // 4))
        points[t] = rng.choice([1, 1, 1, 2, limit, limit + 3])
    df = spark.createDataFrame(list(points.items()), "t long, n long")
    got = sorted((r.t, r["take"]) for r in passing_instants(df, limit, window).collect())
    assert got == admit([(t, min(n, limit)) for t, n in sorted(points.items())], limit, window)


def test_one_long_stretch(spark):
    """Two million instants a microsecond apart are one stretch: the limit passes, then again a window later."""
    df = spark.range(2_000_000).select(F.col("id").alias("t"), F.lit(1).cast("long").alias("n"))
    got = sorted(r.t for r in passing_instants(df, 10, 500_000).where("take > 0").collect())
    assert got == [k * 500_000 + i for k in range(4) for i in range(10)]



@pytest.mark.parametrize("every,limit,eager", [(97, 5, 2), (97, 5, 0), (700, 3, 50), (13, 1, 2)])
def test_one_busy_week(spark, monkeypatch, caplog, every, limit, eager):
    """Alerts over the limit at every moment of a week, cut into runs of a few hours: guesses of the state are wrong again
    and again and have to be repaired, side by side or along the chain."""
    hour, rng = 3_600_000_000, random.Random(every)
    times = sorted({int(rng.random() * 168 * hour) for _ in range(168 * 3600 // every)})
    points = [(t, rng.choice([1, 1, 2, limit])) for t in times]
    df = spark.createDataFrame(points, "t long, n long")
    monkeypatch.setattr(throttle_module, "RUN_ROWS", 12 * 60 * max(1, 60 // every + 1))
    monkeypatch.setattr(throttle_module, "EAGER", eager)
    with caplog.at_level(logging.INFO, logger=throttle_module.__name__):
        got = sorted((r.t, r["take"]) for r in passing_instants(df, limit, hour).where("take > 0").collect())
    assert got == admit([(t, min(n, limit)) for t, n in points], limit, hour)
    slices, rounds = (int(x) for x in re.search(r"runs of (\d+) slices, (\d+) rounds", caplog.text).groups())
    assert slices <= 16 * 60 and 0 < rounds <= eager + 1


@pytest.mark.parametrize("limit,count", [(5, 400), (20, 600), (3, 40)])
def test_throttle_brute_force(spark, limit, count):
    rng = random.Random(limit)
    rows = [(f"id{i:04d}", "f", at(rng.choice([rng.random() * 1200, rng.randrange(400) * 3]))) for i in range(count)]
    got = throttle(alert_rows(spark, rows), limit, WINDOW).collect()
    assert {r["alertId"]: r["throttled"] for r in got} == brute_throttle(rows, limit)


def test_throttle_remembers_earlier_batches(spark):
    rng = random.Random(9)
    rows = [(f"id{i:04d}", "f", at(rng.randrange(600))) for i in range(200)]
    early = [r for r in rows if r[2] < at(300)]
    late = [r for r in rows if r[2] >= at(300)]
    expected = brute_throttle(rows, 6)
    first = throttle(alert_rows(spark, early), 6, WINDOW)
    passed = first.where("not throttled").groupBy(F.unix_micros("timestamp").alias("t")).agg(F.count("*").alias("n"))
    second = throttle(alert_rows(spark, late), 6, WINDOW, earlier=passed)
    got = {r["alertId"]: r["throttled"] for r in first.collect() + second.collect()}
    assert got == expected


def test_end_states(spark):
    rows = [("a1", "f", at(0)), ("a2", "f", at(1)), ("b1", "g", at(2)), ("c1", "h", at(3))]
    got = outcomes(deduplicate(alert_rows(spark, rows)), limit=2).collect()
    assert {r["alertId"]: r["outcome"] for r in got} == {
        "a1": "dispatched", "a2": "deduplicated", "b1": "dispatched", "c1": "throttled"}


@pytest.fixture(scope="module")
def alerts(spark):
    rows = [dict(eventId="x1", eventName="CreateAccessKey", username="u"), dict(eventId="x2", eventName="SecretLook", username="v")]
    return build_alerts(detect(events(spark, rows), load_rules(), history=False))


def test_routing(alerts):
    got = {(r["eventId"], r["channel"]) for r in route(alerts, ["slack", "pagerduty"]).collect()}
    assert got == {("x1", "slack"), ("x2", "slack"), ("x1", "pagerduty"), ("x2", "pagerduty")}
    low = alerts.withColumn("severity", F.lit("low"))
    assert {r["channel"] for r in route(low, ["slack", "pagerduty"]).collect()} == {"slack"}


def test_a_failing_channel_leaves_the_others(alerts, scratch, spark):
    register_channel("broken", lambda: F.lit(True), lambda config: F.raise_error(F.lit("down")).cast("string"))
    failures = write_payloads(with_occurrences(alerts), {"broken": {}, "webhook": {}}, scratch)
    assert list(failures) == ["broken"]
    assert spark.read.parquet(f"{scratch}/channel=webhook").count() == 2
    assert write_payloads(alerts, {"broken": {}}, scratch, dry_run=True) == {}


def test_markdown_blocks(alerts):
    many = F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.concat(F.lit("i"), i.cast("string")))
    row = with_occurrences(alerts).withColumn("indicators", many).withColumn("occurrenceCount", F.lit(3)).select(
        alert_markdown().alias("m")).first()["m"]
    assert "- i10\n- ... and 2 more\n" in row and "i11" not in row and "**Occurrences:** 3\n" in row


def test_chat_mentions_only_critical(alerts):
    rows = payloads(with_occurrences(alerts), {"slack": {"mention_on_critical": False}}).collect()
    assert all("<!channel>" not in r["payload"] for r in rows)


def test_exact_copies_are_told_apart(spark):
    rows = [("a1", "f", at(0))] * 5 + [("b1", "g", at(0))] * 3 + [("a1", "f", at(100))] * 2
    placed = deduplicate(alert_rows(spark, rows), WINDOW)
    assert placed.count() == 10 and placed.where("not duplicate").count() == 3
    plain = alert_rows(spark, rows)
    limited = throttle(plain, 4, WINDOW)
    assert limited.count() == 10 and limited.where("not throttled").count() == 6
