"""Queries over alerts, their end states, payloads and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import metrics as me
from palisade.operators import payloads as pl
from palisade.operators.alerts import build_alerts
from palisade.operators.dedup import alert_groups, deduplicate
from palisade.operators.normalize import normalize
from palisade.operators.rules import load_rules, with_matched_rules
from palisade.operators.throttle import outcomes, throttle
from palisade.plans.detection import detect
from palisade.plans.fixed_forest import fixed_model
from palisade.plans.oracle import alerted, deduplicated, detected, sec, throttled
from palisade.plans.registry import query
from palisade.session import land
from palisade.sources.adapters import base_columns
from palisade.plans.tables import raw_records, sec_events

HOURLY_LIMIT = 5  # low enough to bite on the small tables
ALERT, DET = alerted(), detected()


def _fused(spark, folder, history=True, burst=False, third=True):
    """All three engines; the third is a forest of fixed nodes, which SQL can walk as well."""
    events = sec_events(spark, folder, burst=burst)
    return detect(events, load_rules(), fixed_model(spark) if third else None, history=history)


def _alerts(spark, folder, history=True, burst=False, third=True):
    return build_alerts(_fused(spark, folder, history, burst, third))


def _placed(spark, folder):
    return land(deduplicate(_alerts(spark, folder).select("alertId", "timestamp", "fingerprint")))


@query("q_alerts", f"""
WITH {alerted()} SELECT alertId, title, asev AS severity, eventId, 'new' AS status, array_to_string(methods, '|') AS methods,
  provider, service, type, name, round(overall, 6) AS score, t_us, fp AS fingerprint FROM alert""")
def alerts(spark, folder):
    return _alerts(spark, folder, history=True).select(
        "alertId", "title", "severity", "eventId", "status", F.array_join("detectionMethods", "|").alias("methods"),
        F.col("metadata.sourceProvider").alias("provider"), F.col("metadata.sourceService").alias("service"),
        F.col("metadata.eventType").alias("type"), F.col("metadata.eventName").alias("name"),
        F.round("metadata.overallScore", 6).alias("score"), F.unix_micros("timestamp").alias("t_us"), "fingerprint")


@query("q_alert_severity", f"WITH {ALERT} SELECT eventId, asev AS severity FROM alert")
def severities(spark, folder):
    return _alerts(spark, folder).select("eventId", "severity")


@query("q_alert_title", f"WITH {ALERT} SELECT eventId, title FROM alert")
def titles(spark, folder):
    return _alerts(spark, folder).select("eventId", "title")


@query("q_alert_description", f"WITH {ALERT} SELECT eventId, description FROM alert")
def descriptions(spark, folder):
    return _alerts(spark, folder).select("eventId", "description")


@query("q_alert_indicators", f"WITH {ALERT} SELECT eventId, array_to_string(inds, '|') AS indicators FROM alert")
def indicators(spark, folder):
    return _alerts(spark, folder).select("eventId", F.array_join("indicators", "|").alias("indicators"))


@query("q_fingerprint", f"WITH {ALERT} SELECT fp AS fingerprint, count(*) AS n, min(eventId) AS first_event FROM alert GROUP BY fp")
def fingerprints(spark, folder):
    return _alerts(spark, folder).groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("eventId").alias("first_event"))


@query("q_dedup", f"WITH {deduplicated(history=True)} SELECT alertId, fp AS fingerprint, anchor_us, dup AS duplicate FROM dd")
def dedup(spark, folder):
    return _placed(spark, folder).select("alertId", "fingerprint", F.unix_micros("anchor").alias("anchor_us"), "duplicate")


@query("q_dedup_burst", f"""
WITH {deduplicated(True, window_us=60_000_000)} SELECT alertId, fp AS fingerprint, anchor_us, dup AS duplicate FROM dd""")
def dedup_burst(spark, folder):
    """One-minute windows over the compressed stream of the burst."""
    rows = _alerts(spark, folder, burst=True).select("alertId", "timestamp", "fingerprint")
    placed = deduplicate(rows, window_us=60_000_000)
    return placed.select("alertId", "fingerprint", F.unix_micros("anchor").alias("anchor_us"), "duplicate")


HOUR = 3_600_000_000
THROTTLE_SQL = (
    f"WITH {deduplicated(history=True)}, surv AS (SELECT alertId, t_us FROM dd WHERE NOT dup), "
    f"{throttled(HOURLY_LIMIT, HOUR, 'surv')}"
)


@query("q_throttle", f"{THROTTLE_SQL} SELECT alertId, throttled FROM thr")
def throttle_query(spark, folder):
    survivors = _placed(spark, folder).where("not duplicate")
    return throttle(survivors, HOURLY_LIMIT).select("alertId", "throttled")


@query("q_alert_groups", f"""
WITH {deduplicated(history=True)} SELECT fp AS fingerprint, anchor_us, count(*) AS occurrences, min(t_us) AS first_us, max(t_us) AS last_us
FROM dd GROUP BY 1, 2""")
def groups(spark, folder):
    return alert_groups(_placed(spark, folder)).select(
        "fingerprint", F.unix_micros("anchor").alias("anchor_us"), F.col("occurrenceCount").alias("occurrences"),
        F.unix_micros("firstSeen").alias("first_us"), F.unix_micros("lastSeen").alias("last_us"))


@query("q_alert_outcome", f"""{THROTTLE_SQL}
SELECT d.alertId, CASE WHEN d.dup THEN 'deduplicated' WHEN t.throttled THEN 'throttled' ELSE 'dispatched' END AS outcome
FROM dd d LEFT JOIN thr t ON t.alertId = d.alertId""")
def outcome(spark, folder):
    return outcomes(_placed(spark, folder), HOURLY_LIMIT).select("alertId", "outcome")


# --- payloads -------------------------------------------------------------------------------


@query("q_route_channels", f"""
WITH {ALERT} SELECT channel, asev AS severity, count(*) AS n FROM alert, (VALUES ('slack'), ('email'), ('pagerduty'), ('webhook')) c(channel)
WHERE channel <> 'pagerduty' OR asev IN ('high','critical') GROUP BY 1, 2""")
def routed(spark, folder):
    return pl.route(_alerts(spark, folder), ["slack", "email", "pagerduty", "webhook"]).groupBy("channel", "severity").agg(
        F.count("*").alias("n"))


def _payload(spark, folder, channel, config=None):
    return pl.payloads(pl.with_occurrences(_alerts(spark, folder)), {channel: config or {}})


def _json(path, name):
    return F.get_json_object("payload", path).alias(name)


@query("q_payload_chat", f"""
WITH {ALERT} SELECT alertId, '#security-alerts' AS channel_name, CASE WHEN asev = 'critical' THEN '<!channel> Critical security alert!' ELSE '' END AS text,
  title, left(description, 500) AS body, upper(asev) AS severity, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS at,
  CASE WHEN len(inds) > 0 THEN array_to_string(list_transform(inds[1:5], lambda i: '• ' || i), chr(10)) END AS indicators,
  CAST(t_us // 1000000 AS VARCHAR) AS epoch
FROM alert""")
def chat(spark, folder):
    field = "$.attachments[0].fields"
    return _payload(spark, folder, "slack").select(
        "alertId", _json("$.channel", "channel_name"), _json("$.text", "text"), _json("$.attachments[0].title", "title"),
        _json("$.attachments[0].text", "body"), _json(f"{field}[0].value", "severity"), _json(f"{field}[3].value", "at"),
        _json(f"{field}[4].value", "indicators"), _json("$.attachments[0].ts", "epoch"))


@query("q_payload_mail", f"""
WITH {ALERT} SELECT alertId, '[SECURITY ALERT] ' || title AS subject,
  chr(10) || 'Security Alert' || chr(10) || chr(10) || 'Severity: ' || upper(asev) || chr(10) || 'Alert ID: ' || alertId || chr(10)
  || 'Timestamp: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' || chr(10) || chr(10) || description || chr(10) || chr(10)
  || 'Detection Methods: ' || array_to_string(methods, ', ') || chr(10) || chr(10) || 'Indicators:' || chr(10)
  || array_to_string(list_transform(inds, lambda i: '- ' || i), chr(10)) || chr(10) || chr(10) || '---' || chr(10)
  || 'Palisade security alerts' AS text,
  len(inds) AS n_items
FROM alert""")
def mail(spark, folder):
    rows = _payload(spark, folder, "email")
    items = F.size(F.split(F.get_json_object("payload", "$.html"), "<li>")) - 1
    return rows.select("alertId", _json("$.subject", "subject"), _json("$.text", "text"), items.alias("n_items"))


@query("q_payload_pager", f"""
WITH {ALERT} SELECT alertId, title AS summary, CASE asev WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'error' END AS severity,
  fp AS dedup_key, array_to_string(methods, ', ') AS methods, len(inds[1:10]) AS n_indicators, left(description, 500) AS description
FROM alert WHERE asev IN ('high','critical')""")
def pager(spark, folder):
    return _payload(spark, folder, "pagerduty").select(
        "alertId", _json("$.payload.summary", "summary"), _json("$.payload.severity", "severity"),
        _json("$.dedup_key", "dedup_key"), _json("$.payload.custom_details.detection_methods", "methods"),
        F.json_array_length(F.get_json_object("payload", "$.payload.custom_details.indicators")).alias("n_indicators"),
        _json("$.payload.custom_details.description", "description"))


@query("q_payload_hook", f"""
WITH {ALERT} SELECT alertId, title, description, asev AS severity, eventId, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS at, name,
  fp AS fingerprint, '1' AS occurrences, len(inds) AS n_indicators FROM alert""")
def hook(spark, folder):
    return _payload(spark, folder, "webhook").select(
        _json("$.alertId", "alertId"), _json("$.title", "title"), _json("$.description", "description"),
        _json("$.severity", "severity"), _json("$.eventId", "eventId"), _json("$.timestamp", "at"),
        _json("$.metadata.eventName", "name"), _json("$.fingerprint", "fingerprint"), _json("$.occurrenceCount", "occurrences"),
        F.json_array_length(F.get_json_object("payload", "$.indicators")).alias("n_indicators"))


@query("q_alert_markdown", f"""
WITH {alerted(third=False)} SELECT alertId, '## ' || title || chr(10) || chr(10) || '**Severity:** ' || upper(asev) || chr(10)
  || '**Alert ID:** `' || alertId || '`' || chr(10) || '**Event ID:** `' || eventId || '`' || chr(10)
  || '**Timestamp:** ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' || chr(10) || chr(10)
  || '**Description:**' || chr(10) || description || chr(10) || chr(10)
  || '**Detection Methods:** ' || array_to_string(methods, ', ') || chr(10) || chr(10)
  || CASE WHEN len(inds) > 0 THEN '**Indicators:**' || chr(10)
       || array_to_string(list_transform(inds[1:10], lambda i: '- ' || i), chr(10)) || chr(10)
       || CASE WHEN len(inds) > 10 THEN '- ... and ' || (len(inds) - 10) || ' more' || chr(10) ELSE '' END || chr(10) ELSE '' END
  || '**Additional Context:**' || chr(10) || '- **sourceProvider:** ' || provider || chr(10) || '- **sourceService:** ' || service || chr(10)
  || '- **eventType:** ' || type || chr(10) || '- **eventName:** ' || name || chr(10)
  || '- **overallScore:** ' || CAST(overall AS VARCHAR) || chr(10) AS markdown
FROM alert""")
def markdown(spark, folder):
    """Without the third engine: its score is printed to the last digit, and powers differ there between engines."""
    return pl.with_occurrences(_alerts(spark, folder, third=False)).select("alertId", pl.alert_markdown().alias("markdown"))


# --- reports --------------------------------------------------------------------------------


COUNTS_SQL = f"""
{THROTTLE_SQL}
SELECT 'events_ingested' AS stage, (SELECT count(*) FROM events) AS n
UNION ALL SELECT 'events_normalized', (SELECT count(*) FROM events WHERE event_id % 8 <> 7)
UNION ALL SELECT 'events_processed', (SELECT count(*) FROM base WHERE event_id % 8 < 6 AND (event_id % 8 = 2 OR k <> 13)
    AND NOT (event_id % 8 = 5 AND k % 11 = 0))
UNION ALL SELECT 'alerts_generated', (SELECT count(*) FROM dd)
UNION ALL SELECT 'alerts_dispatched', (SELECT count(*) FROM thr WHERE NOT throttled)
UNION ALL SELECT 'alerts_deduplicated', (SELECT count(*) FROM dd WHERE dup)
UNION ALL SELECT 'alerts_throttled', (SELECT count(*) FROM thr WHERE throttled)"""


@query("q_pipeline_counts", COUNTS_SQL)
@query("q_stage_counts", COUNTS_SQL)
def stage_counts(spark, folder):
    raw = raw_records(spark, folder)
    return me.stage_counts(raw, normalize(raw), land(outcomes(_placed(spark, folder), HOURLY_LIMIT)))


@query("q_error_counts", f"""
WITH base AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT 'normalization' AS component, count(*) AS n FROM base WHERE event_id % 8 = 7
UNION ALL SELECT 'validation', count(*) FROM base WHERE event_id % 8 < 7 AND
  NOT ((event_id % 8 = 2 OR k <> 13) AND event_id % 8 <> 6 AND NOT (event_id % 8 = 5 AND k % 11 = 0))""")
def error_counts(spark, folder):
    raw = raw_records(spark, folder)
    return me.error_counts(raw, normalize(raw))


@query("q_detections_by_method", f"WITH {DET} SELECT unnest(methods) AS method, count(*) AS n FROM det GROUP BY 1")
def by_method(spark, folder):
    return me.detections_by_method(_fused(spark, folder))


@query("q_detections_by_severity", f"WITH {DET} SELECT severity, CAST(sum(len(methods)) AS BIGINT) AS n FROM det WHERE threat GROUP BY 1")
def by_severity(spark, folder):
    return me.detections_by_severity(_fused(spark, folder))


@query("q_threat_rate", f"""
WITH {DET}, p AS (SELECT service AS source_file, count(*) AS events, count_if(len(hits) > 0) AS threats FROM det GROUP BY 1),
u AS (SELECT * FROM p UNION ALL SELECT 'all', CAST(sum(events) AS BIGINT), CAST(sum(threats) AS BIGINT) FROM p)
SELECT source_file, events, threats, round(threats / events * 100, 1) AS rate FROM u""")
def threat_rate(spark, folder):
    """Rules only, as in a sample run; the feed stands for the file."""
    judged = with_matched_rules(sec_events(spark, folder), load_rules()).withColumn(
        "overallThreatDetected", F.size("matchedRules") > 0)
    return me.threat_rate(judged, "sourceService")


@query("q_latency_stats", f"""
WITH base AS (SELECT epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 1000) AS BIGINT) AS e FROM events)
SELECT count(*) AS events, round(CAST(sum(e - s) AS DOUBLE) / count(*) / 1000, 6) AS avg_ms, min(e - s) / CAST(1000 AS DOUBLE) AS min_ms,
  max(e - s) / CAST(1000 AS DOUBLE) AS max_ms, round(count(*) * 1000000.0::DOUBLE / (max(e) - min(s)), 6) AS events_per_second FROM base""")
def latency(spark, folder):
    rows = base_columns(spark, folder).select(
        F.col("timestamp").alias("started"),
        F.timestamp_micros(F.unix_micros("timestamp") + F.floor(F.col("value") * 1000).cast("long")).alias("ended"))
    return me.latency_stats(rows, "started", "ended")


@query("q_hourly_counts", f"WITH {sec()} SELECT (t_us // 3600000000) * 3600000000 AS hour_us, count(*) AS n FROM sec GROUP BY 1")
def hourly(spark, folder):
    return me.period_counts(sec_events(spark, folder)).select(F.unix_micros("period").alias("hour_us"), "n")


@query("q_sliding_counts", f"""
WITH {sec()}, m AS (SELECT provider, unnest(range(0, 5)) AS back, t_us // 60000000 AS minute FROM sec)
SELECT (minute - back) * 60000000 AS window_us, provider AS "sourceProvider", count(*) AS n FROM m GROUP BY 1, 2""")
def sliding(spark, folder):
    return me.sliding_counts(sec_events(spark, folder), "sourceProvider").select(
        F.unix_micros("window_start").alias("window_us"), "sourceProvider", "n")
