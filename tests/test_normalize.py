"""Feeds and normalisation: sample folders, both record shapes, bad values."""

import json
import os

import pytest
import samples
from helpers import events, ids
from pyspark.sql import functions as F

from palisade.operators.alerts import alert_severity
from palisade.operators.fusion import overall_score
from palisade.operators.metrics import threat_rate
from palisade.operators.normalize import (
    CLOUDTRAIL_FIELDS, from_record, is_valid, map_fields, normalize, register_projection, split_valid, to_record, unknown_records,
)
from palisade.operators.rules import RuleError, load_rules, parse_rule
from palisade.plans.detection import detect
from palisade.session import land, landed_count, release
from palisade.sources import feeds, store

FILES = {
    "aws_cloudtrail_sample.json": samples.TRAIL, "aws_guardduty_sample.json": samples.FINDINGS,
    "azure_activity_logs_sample.json": samples.ACTIVITY, "gcp_audit_logs_sample.json": samples.AUDIT,
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("samples")
    for name, rows in FILES.items():
        (path / name).write_text(json.dumps(rows, indent=2))
    (path / "notes.txt").write_text("not a feed")
    return str(path)


@pytest.fixture(scope="module")
def sample_raw(spark, folder):
    return feeds.read_json_arrays(spark, folder).cache()


def raw_of(spark, source, *records):
    return spark.createDataFrame([(source, None, json.dumps(r)) for r in records], "source string, source_file string, body string")


def one(spark, source, record):
    return normalize(raw_of(spark, source, record)).first()


def test_sample_folder(sample_raw):
    got = {(r["source"], r["source_file"]): r["count"] for r in sample_raw.groupBy("source", "source_file").count().collect()}
    assert got == {("aws_cloudtrail", "aws_cloudtrail_sample.json"): 8, ("aws_guardduty", "aws_guardduty_sample.json"): 3,
                   ("azure_activity_logs", "azure_activity_logs_sample.json"): 4, ("gcp_audit_logs", "gcp_audit_logs_sample.json"): 4}


def test_golden_verdicts(sample_raw):
    judged = detect(normalize(sample_raw), load_rules(), history=False).withColumn(
        "by_rules", alert_severity(F.col("matchedRules"), overall_score(F.array().cast("array<double>"))))
    got = {}
    for r in judged.collect():
        rules = [m["ordinal"] for m in r["matchedRules"]]
        got[r["eventId"]] = (r["eventType"], rules, r["by_rules"] if rules else None, r["heuristic"]["score"])
    assert got == samples.VERDICTS


def test_golden_rate(sample_raw):
    judged = detect(normalize(sample_raw, keep=["source_file"]), load_rules(), history=False)
    judged = judged.withColumn("overallThreatDetected", F.size("matchedRules") > 0)
    got = {r["source_file"]: (r["threats"], r["events"], r["rate"]) for r in threat_rate(judged, "source_file").collect()}
    assert got["aws_cloudtrail_sample.json"] == (4, 8, 50.0) and got["aws_guardduty_sample.json"] == (3, 3, 100.0)
    assert got["azure_activity_logs_sample.json"] == (0, 4, 0.0) and got["all"] == (7, 19, 36.8)


def test_cloudtrail_fields(sample_raw):
    rows = {r["eventId"]: r for r in normalize(sample_raw).collect()}
    t3, t5, t6 = rows["t3"], rows["t5"], rows["t6"]
    assert t3["actor"]["sessionId"] == "issuer" and t3["actor"]["username"] is None
    assert (t5["outcome"], t5["outcome_reason"]) == ("failure", "no")
    assert t6["resource"]["resourceId"] == "arn:aws:s3:::b" and rows["t1"]["resource"] is None
    assert rows["z1"]["timestamp"].microsecond == 123456 and rows["z1"]["correlation_id"] == "c"
    assert (rows["z3"]["outcome"], rows["z3"]["severity"], rows["z3"]["eventCategory"]) == ("failure", "high", "Administrative")
    assert rows["g2"]["severity"] == "critical" and rows["g2"]["risk_score"] == 0.95
    assert rows["g1"]["network"]["destinationPort"] == 22 and rows["g3"]["network"] is None
    assert rows["p2"]["severity"] == "medium" and rows["p1"]["actor"]["ipAddress"] == "203.0.113.9"


def test_wrapped_cloudtrail(spark):
    wrapped = dict(EventId="o1", EventName="Outer", EventTime="2024-01-01T00:00:00Z", Username="outer",
                   Resources=[dict(ARN="arn:x", ResourceType="T", ResourceName="N")], CloudTrailEvent=json.dumps(samples.TRAIL[2]))
    raw = feeds.cloudtrail_raw(raw_of(spark, None, wrapped))
    e = normalize(raw).first()
    assert (e["eventId"], e["eventName"], e["actor"]["username"]) == ("t3", "AttachUserPolicy", "outer")
    assert (e["resource"]["resourceName"], e["resource"]["accountId"]) == ("N", "111122223333")
    bare = feeds.cloudtrail_raw(raw_of(spark, None, {**wrapped, "CloudTrailEvent": "{}"}))
    assert normalize(bare).first()["eventName"] == "Outer" and normalize(bare).first()["eventId"] == "o1"


@pytest.mark.parametrize("severity,name,risk", [
    (0, "info", 0.0), (3.9, "low", 0.39), (4, "medium", 0.4), (8.9, "high", 0.89), (10, "critical", 1.0), (11, "medium", 1.1),
    (-1, "medium", -0.1), ("high", "medium", None), (None, "info", 0.0),
])
def test_finding_severity(spark, severity, name, risk):
    record = samples.finding("x", severity, "k")
    if severity is None:
        del record["severity"]
    e = one(spark, "aws_guardduty", record)
    assert e["severity"] == name and (e["risk_score"] is None if risk is None else abs(e["risk_score"] - risk) < 1e-9)


def test_bad_records_are_rejected_not_dropped(spark):
    good = samples.TRAIL[0]
    raw = raw_of(spark, "aws_cloudtrail", good, {**good, "eventTime": "soon"}, {k: v for k, v in good.items() if k != "eventTime"},
                 {**good, "eventID": ""}, {**good, "eventName": ""})
    raw = raw.unionByName(spark.createDataFrame([("aws_cloudtrail", None, "{broken")], raw.schema))
    valid, rejected = split_valid(normalize(raw))
    assert valid.count() == 1 and rejected.count() == 5


def test_missing_gcp_method_and_unknown_source(spark):
    record = {**samples.AUDIT[0]}
    record["protoPayload"] = dict(record["protoPayload"], methodName=None)
    e = one(spark, "gcp_audit_logs", record)
    assert (e["eventType"], e["eventName"]) == ("unknown", "")
    other = raw_of(spark, "aws_config", {"a": 1}).unionByName(raw_of(spark, None, {"a": 1}))
    assert normalize(other).count() == 0 and unknown_records(other).count() == 2


def test_flow_lines(spark):
    lines = spark.createDataFrame([
        (1700000000123, "2 acct eni-1 10.0.0.1  10.0.0.2 5000 443 6 7 800 1 2 REJECT OK"),
        (1700000000124, "2 acct eni-1 - - - - - - - 1 2 - NODATA"), (1700000000125, "too short"),
    ], "timestamp long, message string")
    got = normalize(feeds.flow_raw(lines)).orderBy("timestamp").collect()
    assert [e["eventId"] for e in got] == ["vpc_flow_1700000000123", "vpc_flow_1700000000124"]
    assert got[0]["network"]["source_port"] == 5000 and got[0]["network"]["action"] == "REJECT"
    assert got[1]["network"]["destinationPort"] is None and got[0]["timestamp"].microsecond == 123000


def test_azure_alerts_and_ranges(spark):
    rows = [dict(alert_id=f"s{i}", time_generated=f"2024-01-01T0{i}:00:00Z", display_name="d", severity="Low", alert_type="k") for i in range(4)]
    raw = raw_of(spark, "azure_security_center", *rows)
    start, end = F.lit("2024-01-01 01:00:00").cast("timestamp"), F.lit("2024-01-01 02:00:00").cast("timestamp")
    kept = normalize(feeds.azure_security_alerts(raw, start, end))
    assert ids(kept) == ["s1", "s2"] and kept.first()["severity"] == "low"
    assert ids(feeds.time_range(normalize(raw), start, end)) == ["s1"]  # half-open
    found = raw_of(spark, "aws_guardduty", {**samples.FINDINGS[0], "updatedAt": "2024-01-01T02:00:00.000999Z"})
    assert feeds.guardduty_findings(found, start, end).count() == 1  # same millisecond


def test_gcp_feeds(spark):
    rows = [dict(insertId=f"l{i}", timestamp=f"2024-01-01T0{i}:00:00Z", severity=s, logName="x/cloudaudit.googleapis.com" if i % 2 else "x/y",
                 payload={"a": 1} if i % 2 else "text") for i, s in enumerate(["DEBUG", "INFO", "ERROR", "ALERT"])]
    raw = raw_of(spark, "gcp_cloud_logging", *rows)
    start, end = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-02").cast("timestamp")
    entries = feeds.gcp_log_entries(raw, start, end, "WARNING").orderBy("insert_id").collect()
    assert [(e["insert_id"], e["text_payload"], e["json_payload"] is None) for e in entries] == [("l2", "text", True), ("l3", None, False)]
    audited = feeds.gcp_audit_entries(raw, start, end).select(F.get_json_object("body", "$.insertId").alias("i"), F.get_json_object("body", "$.timestamp").alias("t"))
    assert [r["i"] for r in feeds.latest(audited, 5, "t", "i").collect()] == ["l3", "l1"]
    activity = feeds.azure_activity_records(raw_of(spark, "azure_activity_logs", samples.ACTIVITY[2])).first()
    assert (activity["status"], activity["category"], activity["operation_name"]) == ("Failed", "Administrative", "Microsoft.Storage/accounts/delete")


def test_feeds_are_merged_and_missing_ones_skipped(spark, folder, scratch):
    os.makedirs(f"{scratch}/lines")
    with open(f"{scratch}/lines/a.json", "w") as f:
        f.write("\n".join(json.dumps(r) for r in samples.TRAIL) + "\nnot json\n")
    merged = feeds.read_feeds(spark, [
        dict(path=f"{scratch}/lines", source="aws_cloudtrail"), dict(path=f"{scratch}/absent", source="aws_guardduty"),
        dict(path=folder, reader="json_arrays"),
    ])
    assert merged.count() == 9 + 19
    assert normalize(merged).where(is_valid()).count() == 8 + 19
    assert feeds.read_feeds(spark, [dict(path=f"{scratch}/absent")]).count() == 0
    assert feeds.drop_redelivered(normalize(merged).where(is_valid())).count() == 19


def test_poll_bounds():
    from datetime import datetime, timedelta
    now = datetime(2024, 1, 1, 12)
    assert feeds.poll_bounds(None, now) == (now - timedelta(hours=1), now)
    assert feeds.poll_bounds(now, now + timedelta(minutes=5)) == (now, now + timedelta(minutes=5))


def test_field_mapping(spark):
    row = map_fields(raw_of(spark, "x", samples.TRAIL[0]), CLOUDTRAIL_FIELDS).first()
    assert (row["eventId"], row["username"], row["aws_region"]) == ("t1", "ann", None)


def test_records_roundtrip(spark):
    df = events(spark, [dict(username="u", country="US", resourceId="r", criticality="low", bytes=5, risk=0.5)])
    back, row = from_record(to_record(df)).first(), df.first()
    for name in ("eventId", "timestamp", "actor", "resource", "network", "risk_score", "threatIndicators", "ingestion_timestamp"):
        assert back[name] == row[name] or name == "ingestion_timestamp"


def test_a_new_feed_registers(spark):
    register_projection("aws_custom", "a string", lambda: {"eventId": F.col("__view_aws_custom.a"), "sourceProvider": F.lit("aws")})
    assert one(spark, "aws_custom", {"a": "id-1"})["eventId"] == "id-1"


def test_store(spark, scratch):
    df = events(spark, [dict(offset_us=i * 86_400_000_000) for i in range(4)])
    store.write_events(df.drop("requestParameters", "responseElements", "rawEvent"), f"{scratch}/events")
    read = store.read_store(spark, f"{scratch}/events", "2024-11-14", "2024-11-16")
    assert ids(read) == ["e00001", "e00002"]
    assert "PartitionFilters: [isnotnull(date" in read._jdf.queryExecution().executedPlan().toString()
    gone = store.expired_dates(spark, f"{scratch}/events", F.lit("2024-11-16"), 2)
    assert [str(r["date"]) for r in gone.collect()] == ["2024-11-13"]
    assert ids(store.retained(df, F.lit("2024-11-16"), 2)) == ["e00001", "e00002", "e00003"]


def test_retention_drops_day_partitions(spark, scratch):
    rows = [dict(eventId=f"e{d}", offset_us=d * 86_400_000_000) for d in range(5)]
    df = events(spark, rows)
    store.write_events(df, f"{scratch}/events")
    gone = store.drop_expired(spark, f"{scratch}/events", F.lit("2024-11-17"), 2)
    assert gone == ["2024-11-13", "2024-11-14"]
    assert sorted(r.eventId for r in spark.read.parquet(f"{scratch}/events").collect()) == ["e2", "e3", "e4"]


def test_release_deletes_what_was_landed(spark):
    mark = landed_count(spark)
    first, second = land(spark.range(3)), land(spark.range(4))
    file = first.inputFiles()[0]
    assert first.count() + second.count() == 7 and landed_count(spark) == mark + 2
    assert release(spark, mark) == 2 and landed_count(spark) == mark
    with pytest.raises(Exception, match="(?i)not.?found|not.?exist|file"):
        spark.read.parquet(file).count()


def test_bad_patterns_are_refused(spark):
    with pytest.raises(RuleError):
        parse_rule({"name": "r", "conditions": [{"field": "eventName", "operator": "regex", "value": "(?P<n>a)"}]})
    assert parse_rule({"name": "r", "conditions": [{"field": "eventName", "operator": "regex", "value": "^a+$"}]}).conditions
