"""Queries over feeds, normalisation and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.functions.classify import (
    AZURE_ACTIVITY_LEVELS, AZURE_ALERT_SEVERITIES, GCP_SEVERITIES, classify_aws, classify_gcp, finding_severity, mapped,
)
from palisade.operators import enrich as en
from palisade.operators.metrics import display_event, display_user
from palisade.operators.normalize import (
    GCP_AUDIT_FIELDS, at, from_record, is_valid, map_fields, normalize, to_record, unknown_records,
)
from palisade.operators.prefixes import match, with_prefixes
from palisade.plans.oracle import AWS_TIERS, BASE, GCP_TIERS, classified, sec
from palisade.plans.registry import query
from palisade.plans.tables import raw_records, sec_events
from palisade.sources import adapters as ad
from palisade.sources import feeds
from palisade.sources.store import retained

def us():
    return F.unix_micros("timestamp").alias("t_us")

FLOW_SQL = f"""
WITH {BASE},
lines AS (
  SELECT (us // 1000) AS ms, '2 acct eni-' || (user_id % 7) || ' 203.0.113.' || (user_id % 20) || ' 10.0.0.' || k || ' ' || (k + 1024)
    || ' 443  6 ' || (k + 1) || ' ' || CAST(floor(value * 100) AS BIGINT) || ' ' || (us // 1000000) || ' ' || (us // 1000000 + 60)
    || CASE WHEN event_id % 10 <> 0 THEN CASE WHEN event_type = 'error' THEN ' REJECT' ELSE ' ACCEPT' END || '  OK ' ELSE '' END AS line
  FROM base
),
parts AS (SELECT ms, regexp_split_to_array(trim(line), '\\s+') AS p FROM lines)
SELECT ms AS "timestamp", p[2] AS account_id, p[3] AS interface_id, p[4] AS src_addr, p[5] AS dst_addr, p[6] AS src_port,
  p[7] AS dst_port, p[8] AS protocol, p[9] AS packets, p[10] AS bytes, p[13] AS action
FROM parts WHERE len(p) >= 14"""


@query("q_flow_parse", FLOW_SQL)
def flow_parse(spark, folder):
    return feeds.parse_flow_lines(ad.flow_lines(spark, folder)).drop("raw_message")


@query("q_flow_events", f"""
WITH {BASE}
SELECT 'vpc_flow_' || (us // 1000) AS event_id, (us // 1000) AS ms, '203.0.113.' || (user_id % 20) AS src, k + 1024 AS sport,
  '10.0.0.' || k AS dst, 443 AS dport, CAST(floor(value * 100) AS BIGINT) AS bytes, k + 1 AS packets,
  CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS action
FROM base WHERE event_id % 10 <> 0""")
def flow_events(spark, folder):
    events = normalize(feeds.flow_raw(ad.flow_lines(spark, folder)))
    return events.select(
        F.col("eventId").alias("event_id"), F.unix_millis("timestamp").alias("ms"), F.col("network.sourceIp").alias("src"),
        F.col("network.source_port").alias("sport"), F.col("network.destinationIp").alias("dst"),
        F.col("network.destinationPort").alias("dport"), F.col("network.bytesSent").alias("bytes"),
        F.col("network.packets").alias("packets"), F.col("network.action").alias("action"))


LEVELS = "(['DEFAULT','DEBUG','INFO','NOTICE','WARNING','ERROR','CRITICAL','ALERT','EMERGENCY'])[1 + k % 9]"


@query("q_min_severity", f"""
WITH {BASE} SELECT 'raw-' || event_id AS insert_id, {LEVELS} AS severity, event_type AS text_payload
FROM base WHERE event_id % 8 = 6 AND k % 9 >= 4 AND k <> 13""")
def min_severity(spark, folder):
    raw = raw_records(spark, folder).where("source = 'gcp_cloud_logging'")
    entries = feeds.gcp_log_entries(
        raw, F.lit("2024-01-01").cast("timestamp"), F.lit("2024-12-31").cast("timestamp"),
        "WARNING")
    return entries.select("insert_id", "severity", "text_payload")


@query("q_union_feeds", f"""
WITH {sec()} SELECT provider AS sourceProvider, count(*) AS n, count_if(provider = 'aws') AS with_user, count_if(provider <> 'aws') AS with_mail
FROM sec GROUP BY provider""")
def union_feeds(spark, folder):
    events = sec_events(spark, folder)
    aws = events.where("sourceProvider = 'aws'").select("eventId", "sourceProvider", F.col("actor.username").alias("user"))
    others = [
        events.where(F.col("sourceProvider") == p).select("eventId", "sourceProvider", F.col("actor.username").alias("mail"))
        for p in ("azure", "gcp")
    ]
    merged = feeds.drop_redelivered(feeds.union_feeds([aws, *others, aws]))
    return merged.groupBy("sourceProvider").agg(
        F.count("*").alias("n"), F.count("user").alias("with_user"), F.count("mail").alias("with_mail"))


@query("q_time_range", f"""
WITH {sec()} SELECT eventId, t_us FROM sec WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20 12:00:00'""")
def time_range(spark, folder):
    events = sec_events(spark, folder)
    start, end = F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20 12:00:00").cast("timestamp")
    return feeds.time_range(events, start, end).select("eventId", us())


@query("q_latest_events", f"WITH {sec()} SELECT eventId, t_us FROM sec ORDER BY ts DESC, eventId LIMIT 50")
def latest_events(spark, folder):
    return feeds.latest(sec_events(spark, folder), 50).select("eventId", us())


@query("q_route_counts", f"""
WITH {BASE} SELECT (['aws','aws','aws','azure','azure','gcp','gcp','unknown'])[1 + event_id % 8] AS provider,
  (['cloudtrail','guardduty','vpc_flow_logs','activityLogs','security_center','gcp_audit_logs','gcp_cloud_logging','unknown'])[1 + event_id % 8] AS service,
  count(*) AS n FROM base GROUP BY 1, 2""")
def route_counts(spark, folder):
    raw = raw_records(spark, folder)
    known = normalize(raw).select(F.col("sourceProvider").alias("provider"), F.col("sourceService").alias("service"))
    unknown = unknown_records(raw).select(F.lit("unknown").alias("provider"), F.lit("unknown").alias("service"))
    return known.unionByName(unknown).groupBy("provider", "service").agg(F.count("*").alias("n"))


PURCHASES = "(['CreateAccessKey','DeleteTrail','AttachUserPolicy','AuthorizeSecurityGroupIngress','TerminateInstances','UpdateFunction','DeleteBucket','PutRolePolicy'])[1 + k % 8]"


def _normalized(spark, folder, source):
    raw = raw_records(spark, folder)
    return normalize(raw.where(F.col("source") == source))


@query("q_norm_trail", f"""
WITH {BASE}, n AS (SELECT *, {PURCHASES} AS name FROM base WHERE event_id % 8 = 0)
SELECT 'raw-' || event_id AS eventId, CASE WHEN k <> 13 THEN us END AS t_us, name, {classified('name', AWS_TIERS)} AS type,
  CASE WHEN k % 10 <> 0 THEN 'user_' || user_id ELSE 'outer_user' END AS username, 'P' || user_id AS principal,
  CASE WHEN k % 3 = 0 THEN 'role' END AS session, '203.0.113.' || (user_id % 20) AS ip,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome,
  CASE WHEN event_type = 'error' THEN 'denied' END AS reason,
  CASE WHEN k % 4 <> 0 THEN 'arn:res-' || (k % 25) END AS arn,
  CASE WHEN k % 4 <> 0 THEN '123456789012' END AS account, k % 2 = 0 AS mfa
FROM n""")
def norm_trail(spark, folder):
    e = _normalized(spark, folder, "aws_cloudtrail")
    return e.select(
        "eventId", us(), F.col("eventName").alias("name"), F.col("eventType").alias("type"),
        F.col("actor.username").alias("username"), F.col("actor.userId").alias("principal"),
        F.col("actor.sessionId").alias("session"), F.col("actor.ipAddress").alias("ip"), "outcome",
        F.col("outcome_reason").alias("reason"), F.col("resource.resourceId").alias("arn"),
        F.col("resource.accountId").alias("account"),
        F.try_variant_get("requestParameters", "$.mfaUsed", "boolean").alias("mfa"))


@query("q_norm_finding", f"""
WITH {BASE}
SELECT 'raw-' || event_id AS eventId, CASE WHEN k <> 13 THEN us END AS t_us, 'Recon:EC2/' || event_type AS name,
  CASE WHEN k % 17 = 0 THEN 'medium' WHEN k % 19 = 0 THEN 'info' WHEN k < 10 THEN 'info' WHEN k < 40 THEN 'low'
       WHEN k < 70 THEN 'medium' WHEN k < 90 THEN 'high' ELSE 'critical' END AS severity,
  CASE WHEN k % 17 = 0 THEN NULL WHEN k % 19 = 0 THEN 0.0 ELSE round((CAST(k AS DOUBLE) / 10) / 10, 6) END AS risk,
  'Recon:EC2/' || event_type AS indicator,
  CASE WHEN k % 2 = 0 THEN '198.51.100.' || (k % 10) END AS src, CASE WHEN k % 2 = 0 THEN k END AS dport
FROM base WHERE event_id % 8 = 1""")
def norm_finding(spark, folder):
    e = _normalized(spark, folder, "aws_guardduty")
    return e.select(
        "eventId", us(), F.col("eventName").alias("name"), "severity", F.round("risk_score", 6).alias("risk"),
        F.array_join("threatIndicators", "|").alias("indicator"), F.col("network.sourceIp").alias("src"),
        F.col("network.destinationPort").alias("dport"))


@query("q_norm_flow", f"""
WITH {BASE}
SELECT 'vpc_flow_' || (us // 1000) AS eventId, (us // 1000) AS ms, k + 1024 AS sport, CASE WHEN k % 5 <> 0 THEN 443 END AS dport,
  CAST(floor(value * 100) AS BIGINT) AS bytes, CAST(k AS BIGINT) AS packets,
  CASE WHEN event_type = 'error' THEN 'REJECT' ELSE 'ACCEPT' END AS action, 'network_traffic' AS type
FROM base WHERE event_id % 8 = 2""")
def norm_flow(spark, folder):
    e = _normalized(spark, folder, "aws_vpc_flow_logs")
    return e.select("eventId", F.unix_millis("timestamp").alias("ms"), F.col("network.source_port").alias("sport"),
                    F.col("network.destinationPort").alias("dport"), F.col("network.bytesSent").alias("bytes"),
                    F.col("network.packets").alias("packets"), F.col("network.action").alias("action"),
                    F.col("eventType").alias("type"))


@query("q_norm_activity", f"""
WITH {BASE}
SELECT 'raw-' || event_id AS eventId, CASE WHEN k <> 13 THEN us END AS t_us, 'Microsoft.Compute/' || event_type AS name,
  (['critical','high','medium','info','info'])[1 + k % 5] AS severity, 'user_' || user_id AS caller,
  CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS outcome, '/res/' || k AS resource,
  'Administrative' AS category, 'c-1' AS correlation
FROM base WHERE event_id % 8 = 3""")
def norm_activity(spark, folder):
    e = _normalized(spark, folder, "azure_activity_logs")
    return e.select("eventId", us(), F.col("eventName").alias("name"), "severity", F.col("actor.email").alias("caller"),
                    "outcome", F.col("resource.resourceId").alias("resource"), F.col("eventCategory").alias("category"),
                    F.col("correlation_id").alias("correlation"))


@query("q_norm_security", f"""
WITH {BASE}
SELECT 'raw-' || event_id AS eventId, CASE WHEN k <> 13 THEN us END AS t_us, 'Alert ' || event_type AS name,
  (['high','medium','low','info','medium'])[1 + k % 5] AS severity, 'VM_Suspicious' AS indicator, 'security_alert' AS type
FROM base WHERE event_id % 8 = 4""")
def norm_security(spark, folder):
    e = _normalized(spark, folder, "azure_security_center")
    return e.select("eventId", us(), F.col("eventName").alias("name"), "severity",
                    F.array_join("threatIndicators", "|").alias("indicator"), F.col("eventType").alias("type"))


METHOD = "CASE WHEN k % 11 <> 0 THEN (['v1.compute.instances.insert','storage.buckets.create','SetIamPolicy','projects.list','UserLogin','x.delete'])[1 + k % 6] ELSE '' END"


@query("q_norm_gcp", f"""
WITH {BASE}, n AS (SELECT *, {METHOD} AS name FROM base WHERE event_id % 8 = 5)
SELECT 'raw-' || event_id AS eventId, CASE WHEN k <> 13 THEN us END AS t_us, name, {classified('name', GCP_TIERS)} AS type,
  (['info','info','info','info','medium','high','critical','info','info'])[1 + k % 9] AS severity,
  'user_' || user_id || '@example.com' AS email, 'projects/' || k AS resource, 'unknown' AS outcome
FROM n""")
def norm_gcp(spark, folder):
    e = _normalized(spark, folder, "gcp_audit_logs")
    return e.select("eventId", us(), F.col("eventName").alias("name"), F.col("eventType").alias("type"), "severity",
                    F.col("actor.email").alias("email"), F.col("resource.resourceName").alias("resource"), "outcome")


@query("q_classify_aws", f"""
WITH {sec()} SELECT name, {classified('name', AWS_TIERS)} AS kind, count(*) AS n FROM sec GROUP BY 1, 2""")
def classify_aws_names(spark, folder):
    e = sec_events(spark, folder)
    return e.groupBy(F.col("eventName").alias("name"), classify_aws(F.col("eventName")).alias("kind")).agg(F.count("*").alias("n"))


@query("q_classify_gcp", f"""
WITH {sec()} SELECT name, {classified('name', GCP_TIERS)} AS kind, count(*) AS n FROM sec GROUP BY 1, 2""")
def classify_gcp_names(spark, folder):
    e = sec_events(spark, folder)
    return e.groupBy(F.col("eventName").alias("name"), classify_gcp(F.col("eventName")).alias("kind")).agg(F.count("*").alias("n"))


@query("q_severity_map", f"""
WITH {BASE} SELECT k,
  CASE WHEN k % 13 < 1 THEN 'info' WHEN k % 13 < 4 THEN 'low' WHEN k % 13 < 7 THEN 'medium' WHEN k % 13 < 9 THEN 'high'
       WHEN k % 13 < 11 THEN 'critical' ELSE 'medium' END AS finding,
  (['critical','high','medium','info','info'])[1 + k % 5] AS activity,
  (['high','medium','low','info','medium'])[1 + k % 5] AS alert,
  (['info','info','info','info','medium','high','critical','info','info'])[1 + k % 9] AS log, count(*) AS n
FROM base GROUP BY k""")
def severity_map(spark, folder):
    rows = ad.base_columns(spark, folder)
    k = F.col("k")
    return rows.select(
        "k", finding_severity((k % 13).cast("double") + 0.5).alias("finding"),
        mapped(ad._pick(ad.AZURE_LEVELS, k % 5), AZURE_ACTIVITY_LEVELS, "info").alias("activity"),
        mapped(ad._pick(ad.ALERT_LEVELS, k % 5), AZURE_ALERT_SEVERITIES, "medium").alias("alert"),
        mapped(ad._pick(ad.LOG_LEVELS, k % 9), GCP_SEVERITIES, "info").alias("log"),
    ).groupBy("k", "finding", "activity", "alert", "log").agg(F.count("*").alias("n"))


@query("q_json_path", f"""
WITH {BASE} SELECT event_id, CAST(k AS VARCHAR) AS k_text, CAST(NULL AS VARCHAR) AS missed FROM base""")
def json_path(spark, folder):
    rows = ad.base_columns(spark, folder).select("event_id", F.col("props").alias("body"))
    return rows.select("event_id", at("k").alias("k_text"), at("k.deeper.still").alias("missed"))


@query("q_map_fields", f"""
WITH {BASE}, n AS (SELECT *, {METHOD} AS name FROM base WHERE event_id % 8 = 5 AND k % 2 = 0)
SELECT nullif(name, '') AS method_name, 'user_' || user_id || '@example.com' AS principal_email, '203.0.113.9' AS caller_ip,
  'projects/' || k AS resource_name, count(*) AS n FROM n GROUP BY 1, 2, 3, 4""")
def mapped_fields(spark, folder):
    raw = raw_records(spark, folder).where("source = 'gcp_audit_logs'")
    fields = map_fields(raw, GCP_AUDIT_FIELDS).where("resource_name is not null")
    keys = ["method_name", "principal_email", "caller_ip", "resource_name"]
    return fields.groupBy(*keys).agg(F.count("*").alias("n"))


@query("q_validate_split", f"""
WITH {BASE}, n AS (
  SELECT (['aws','aws','aws','azure','azure','gcp','gcp'])[1 + event_id % 8] AS provider,
    (event_id % 8 = 2 OR k <> 13) AND NOT (event_id % 8 = 6) AND NOT (event_id % 8 = 5 AND k % 11 = 0) AS valid
  FROM base WHERE event_id % 8 < 7)
SELECT provider, valid, count(*) AS n FROM n GROUP BY 1, 2""")
def validate_split(spark, folder):
    e = normalize(raw_records(spark, folder))
    return e.groupBy(F.col("sourceProvider").alias("provider"), is_valid().alias("valid")).agg(F.count("*").alias("n"))


@query("q_json_roundtrip", f"""
WITH {sec()} SELECT eventId, t_us, name, username, country, resource, criticality, bytes, risk, mfa, outcome FROM sec""")
def json_roundtrip(spark, folder):
    e = from_record(to_record(sec_events(spark, folder)))
    return e.select("eventId", us(), F.col("eventName").alias("name"), F.col("actor.username").alias("username"),
                    F.col("actor.geo_location.country").alias("country"), F.col("resource.resourceId").alias("resource"),
                    F.col("resource.tags")["criticality"].alias("criticality"), F.col("network.bytesSent").alias("bytes"),
                    F.col("risk_score").alias("risk"),
                    F.try_variant_get("requestParameters", "$.mfaUsed", "boolean").alias("mfa"), "outcome")


@query("q_display_name", f"""
WITH {BASE}, n AS (SELECT *, {METHOD} AS method FROM base)
SELECT CASE event_id % 8 WHEN 0 THEN CASE WHEN event_id % 16 = 0 THEN 'Outer' ELSE {PURCHASES} END
    WHEN 3 THEN CASE WHEN k % 2 <> 0 THEN 'Microsoft.Compute/' || event_type ELSE 'Unknown' END
    WHEN 5 THEN CASE WHEN k % 2 = 0 AND method <> '' THEN method ELSE 'Unknown' END
    ELSE 'Unknown' END AS event,
  CASE event_id % 8 WHEN 0 THEN CASE WHEN event_id % 16 = 0 THEN 'Unknown' WHEN k % 10 <> 0 THEN 'user_' || user_id ELSE 'IAMUser' END
    WHEN 3 THEN 'user_' || user_id
    WHEN 5 THEN CASE WHEN k % 2 = 0 THEN 'user_' || user_id || '@example.com' ELSE 'Unknown' END
    ELSE 'Unknown' END AS "user", count(*) AS n
FROM n GROUP BY 1, 2""")
def display_name(spark, folder):
    raw = raw_records(spark, folder)
    return raw.groupBy(display_event().alias("event"), display_user().alias("user")).agg(F.count("*").alias("n"))


# --- enrichment -----------------------------------------------------------------------------

GEO = """geo AS (SELECT n_nationkey * 4 AS lo, n_nationkey * 4 + 3 AS hi, n_name, 'city-' || n_nationkey AS city,
  CAST(n_nationkey AS DOUBLE) AS lat FROM nation WHERE n_nationkey % 3 <> 2)"""


@query("q_geo_join", f"""
WITH {sec()}, {GEO}
SELECT eventId, ip, coalesce(n_name, 'Unknown') AS country, coalesce(city, 'Unknown') AS city, coalesce(lat, 0.0) AS latitude,
  coalesce(n_name, 'Unknown') AS actor_country
FROM sec LEFT JOIN geo ON CAST(string_split(ip, '.')[4] AS INT) BETWEEN lo AND hi""")
def geo_join(spark, folder):
    e = en.enrich_geo(sec_events(spark, folder), ad.geo_ranges(spark, folder))
    geo = "enrichment.geo_ip"
    return e.select("eventId", F.col(f"{geo}.ip").alias("ip"), F.col(f"{geo}.country").alias("country"),
                    F.col(f"{geo}.city").alias("city"), F.col(f"{geo}.latitude").alias("latitude"),
                    F.col("actor.geo_location.country").alias("actor_country"))


NESTED = """
spans AS (
  SELECT n_name, n_nationkey AS n, n_nationkey BETWEEN 3 AND 5 AS six,
    CASE n_nationkey WHEN 0 THEN -3405803776 WHEN 1 THEN -28928 WHEN 2 THEN 3 WHEN 3 THEN -1e30 WHEN 4 THEN 0 WHEN 5 THEN 17 ELSE n_nationkey END::DOUBLE AS lo,
    CASE n_nationkey WHEN 0 THEN 889163519 WHEN 1 THEN 16748287 WHEN 2 THEN 12 WHEN 3 THEN 1e30 WHEN 4 THEN 47 WHEN 5 THEN 28 ELSE n_nationkey + 1 END::DOUBLE AS hi
  FROM nation),
asked AS (SELECT eventId, k % 2 = 1 AS six, CASE WHEN k % 2 = 1 THEN k ELSE string_split(ip, '.')[4]::INT END AS place FROM sec)"""


@query("q_geo_prefix", f"""
WITH {sec()}, {NESTED}
SELECT eventId, arg_min(n_name, (hi - lo, lo)) AS country, count(*) AS n_ranges
FROM asked JOIN spans ON asked.six = spans.six AND place BETWEEN lo AND hi GROUP BY eventId""")
def geo_prefix(spark, folder):
    """IPv4 and IPv6 addresses in nested ranges, the widest of which hold every address; offsets from 203.0.113.0 and 2001:db8::
    in the SQL."""
    k = F.col("network.source_port") - 1024
    six = F.concat(F.lit("2001:DB8:0:0::"), F.hex(k))
    asked = sec_events(spark, folder).select("eventId", F.when(k % 2 == 1, six).otherwise(F.col("actor.ipAddress")).alias("ip"))
    ranges = ad.nested_ranges(spark, folder)
    every = match(asked.select("ip").distinct(), "ip", with_prefixes(ranges, "start_ip", "end_ip")).groupBy("ip").agg(F.count("*").alias("n_ranges"))
    return en.locate(asked, "ip", ranges).join(every, "ip").select("eventId", F.col("geo.country").alias("country"), "n_ranges")


@query("q_threat_networks", f"""
WITH {sec()}, h AS (
  SELECT *, list_filter([ip, sip, dip], lambda x: starts_with(x, '198.51.100.')
    OR starts_with(x, '192.0.2.') AND (string_split(x, '.')[4]::INT = 1 OR string_split(x, '.')[4]::INT BETWEEN 8 AND 15)) AS found FROM sec)
SELECT eventId, array_to_string(found, '|') AS found,
  array_to_string(list_transform(found, lambda x: CASE WHEN x = '198.51.100.7' THEN 'own' WHEN x[:6] = '198.51' THEN 'wide' ELSE 'near' END), '|') AS sources FROM h""")
def threat_networks(spark, folder):
    """A list of addresses and networks, one inside another."""
    listed = [("192.0.2.1", "near"), ("192.0.2.8/29", "near"), ("198.51.100.0/28", "wide"), ("198.51.0.0/16", "wider"), ("198.51.100.7/32", "own"), ("2001:db8::/32", "six")]
    e = en.enrich_threats(sec_events(spark, folder), spark.createDataFrame(listed, "ip string, feed string"))
    intel = "enrichment.threatIntel"
    return e.select("eventId", F.array_join(f"{intel}.indicators_found", "|").alias("found"), F.array_join(f"{intel}.sources", "|").alias("sources"))


@query("q_threat_intel", f"""
WITH {sec()}, h AS (
  SELECT *, list_filter([ip, sip, dip], lambda x: x IN ('192.0.2.1','198.51.100.1','203.0.113.1')) AS found FROM sec)
SELECT eventId, array_to_string(found, '|') AS found, CASE WHEN len(found) > 0 THEN 'high' ELSE 'none' END AS level,
  len(found) AS n_sources, array_to_string(list_transform(found, lambda x: 'malicious_ip:' || x), '|') AS indicators,
  CASE WHEN len(found) > 0 THEN least(coalesce(risk, 0.5) * 2.0, 1.0) ELSE risk END AS risk
FROM h""")
def threat_intel(spark, folder):
    e = en.enrich_threats(sec_events(spark, folder), en.default_threat_list(spark))
    intel = "enrichment.threatIntel"
    return e.select("eventId", F.array_join(f"{intel}.indicators_found", "|").alias("found"),
                    F.col(f"{intel}.threat_level").alias("level"), F.size(f"{intel}.sources").alias("n_sources"),
                    F.array_join("threatIndicators", "|").alias("indicators"), F.col("risk_score").alias("risk"))


@query("q_asset_join", f"""
WITH {sec()}, assets AS (SELECT 'res-' || n_nationkey AS rid, n_name AS owner, CASE WHEN n_nationkey % 2 = 0 THEN 'high' END AS crit,
  CAST(n_nationkey AS BIGINT) * 86400 AS seen FROM nation WHERE n_nationkey % 4 <> 3)
SELECT eventId, resource, coalesce(owner, 'Unknown') AS owner, coalesce(crit, 'medium') AS criticality, sec.criticality AS tag, seen
FROM sec LEFT JOIN assets ON rid = resource""")
def asset_join(spark, folder):
    e = en.enrich_assets(sec_events(spark, folder), ad.assets(spark, folder))
    a = "enrichment.asset_inventory"
    return e.select("eventId", F.col(f"{a}.resource_id").alias("resource"), F.col(f"{a}.owner").alias("owner"),
                    F.col(f"{a}.criticality").alias("criticality"), F.col(f"{a}.tags")["criticality"].alias("tag"),
                    F.unix_seconds(f"{a}.last_seen").alias("seen"))


@query("q_dns_join", f"""
WITH {sec()} SELECT eventId, CASE WHEN n_name IS NOT NULL THEN ip END AS ip, 'host-' || lower(n_name) AS hostname
FROM sec LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) n ON ip = '203.0.113.' || n_nationkey""")
def dns_join(spark, folder):
    e = en.enrich_dns(sec_events(spark, folder), ad.reverse_dns(spark, folder))
    return e.select("eventId", F.col("enrichment.dns.ip").alias("ip"), F.col("enrichment.dns.hostname").alias("hostname"))


@query("q_enrich_all", f"""
WITH {sec()}, {GEO}
SELECT coalesce(g.n_name, 'Unknown') AS country, CASE WHEN len(list_filter([ip, sip, dip],
    lambda x: x IN ('192.0.2.1','198.51.100.1','203.0.113.1'))) > 0 THEN 'high' ELSE 'none' END AS level,
  coalesce(a.n_name, 'Unknown') AS owner, 'host-' || lower(d.n_name) AS hostname, count(*) AS n
FROM sec LEFT JOIN geo g ON CAST(string_split(ip, '.')[4] AS INT) BETWEEN lo AND hi
LEFT JOIN nation a ON resource = 'res-' || a.n_nationkey AND a.n_nationkey % 4 <> 3
LEFT JOIN nation d ON ip = '203.0.113.' || d.n_nationkey AND d.n_nationkey % 2 = 0
GROUP BY 1, 2, 3, 4""")
def enrich_all(spark, folder):
    dims = {"geo_ip": ad.geo_ranges(spark, folder), "threat_intel": en.default_threat_list(spark),
            "asset_inventory": ad.assets(spark, folder), "dns": ad.reverse_dns(spark, folder)}
    e = en.enrich(sec_events(spark, folder), dims)
    return e.groupBy(F.col("enrichment.geo_ip.country").alias("country"),
                     F.col("enrichment.threatIntel.threat_level").alias("level"),
                     F.col("enrichment.asset_inventory.owner").alias("owner"),
                     F.col("enrichment.dns.hostname").alias("hostname")).agg(F.count("*").alias("n"))


@query("q_retention", f"""
WITH {sec()} SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM sec
WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 20 GROUP BY 1""")
def retention(spark, folder):
    kept = retained(sec_events(spark, folder), F.lit("2024-01-31"), 20)
    return kept.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


# --- collectors: provider records and their time ranges ------------------------------------------

FROM_DAY, TO_DAY = "2024-01-05", "2024-01-20"
IN_RANGE = f"us >= epoch_us(TIMESTAMP '{FROM_DAY}') AND us <= epoch_us(TIMESTAMP '{TO_DAY}')"


def _records(spark, folder, source):
    return raw_records(spark, folder).where(F.col("source") == source)


def _days():
    return F.lit(FROM_DAY).cast("timestamp"), F.lit(TO_DAY).cast("timestamp")


@query("q_feed_trail", f"""
WITH {BASE} SELECT 'raw-' || event_id AS event_id, event_type AS name, 'user_' || user_id AS username, us AS t_us, 'r' || (k % 4) AS region FROM base""")
def feed_trail(spark, folder):
    """Look-up records as the collector lands them: the event is a JSON string inside."""
    rows = ad.base_columns(spark, folder)
    inner = F.to_json(F.struct(F.concat(F.lit("r"), (F.col("k") % 4).cast("string")).alias("awsRegion")))
    raw = rows.select(F.lit("aws_cloudtrail").alias("source"), F.lit("trail.json").alias("source_file"), F.to_json(F.struct(
        F.concat(F.lit("raw-"), F.col("event_id").cast("string")).alias("EventId"), F.col("event_type").alias("EventName"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("EventTime"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("Username"), inner.alias("CloudTrailEvent"))).alias("body"))
    return feeds.cloudtrail_records(raw).select(
        F.col("eventId").alias("event_id"), F.col("eventName").alias("name"), "username", F.unix_micros("eventTime").alias("t_us"),
        F.try_variant_get("cloud_trail_event", "$.awsRegion", "string").alias("region"))


@query("q_feed_findings", f"WITH {BASE} SELECT 'raw-' || event_id AS id FROM base WHERE event_id % 8 = 1 AND k <> 13 AND {IN_RANGE}")
def feed_findings(spark, folder):
    found = feeds.guardduty_findings(_records(spark, folder, "aws_guardduty"), *_days())
    return found.select(F.coalesce(F.get_json_object("body", "$.id"), F.get_json_object("body", "$.finding_id")).alias("id"))


@query("q_feed_activity", f"""
WITH {BASE} SELECT 'raw-' || event_id AS id, 'user_' || user_id AS caller, CASE WHEN event_type = 'error' THEN 'Failed' ELSE 'Succeeded' END AS status,
  'Microsoft.Compute/' || event_type AS operation, '/res/' || k AS resource, CASE WHEN k <> 13 THEN us END AS t_us FROM base WHERE event_id % 8 = 3""")
def feed_activity(spark, folder):
    return feeds.azure_activity_records(_records(spark, folder, "azure_activity_logs")).select(
        F.col("event_data_id").alias("id"), "caller", "status", F.col("operation_name").alias("operation"),
        F.col("resource_id").alias("resource"), F.unix_micros("event_timestamp").alias("t_us"))


@query("q_feed_alerts", f"WITH {BASE} SELECT 'raw-' || event_id AS id FROM base WHERE event_id % 8 = 4 AND k <> 13 AND {IN_RANGE}")
def feed_alerts(spark, folder):
    return feeds.azure_security_alerts(_records(spark, folder, "azure_security_center"), *_days()).select(
        F.get_json_object("body", "$.alert_id").alias("id"))


@query("q_feed_audit", f"WITH {BASE} SELECT 'raw-' || event_id AS id FROM base WHERE event_id % 8 = 5 AND k % 2 = 0 AND {IN_RANGE}")
def feed_audit(spark, folder):
    return feeds.gcp_audit_entries(_records(spark, folder, "gcp_audit_logs"), *_days()).select(
        F.get_json_object("body", "$.insertId").alias("id"))
