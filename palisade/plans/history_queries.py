"""Queries over heuristics, baselines, features and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import anomaly as an
from palisade.operators import heuristics as he
from palisade.operators import rollups as ro
from palisade.operators.fusion import result_record, rule_score
from palisade.operators.rules import load_rules, with_matched_rules
from palisade.plans.detection import detect
from palisade.plans.fixed_forest import fixed_model
from palisade.plans.oracle import FEATURE_SQL, HISTORY, KEYWORD, detected, matched, sec
from palisade.plans.registry import query
from palisade.session import land
from palisade.plans.tables import sec_events

HIST = f"{sec()}, {matched()}, {HISTORY}"
HIST_BURST = f"{sec(True)}, {matched()}, {HISTORY}"


@query("q_freq_user", f"WITH {HIST_BURST} SELECT eventId, n_user AS user_count FROM flags WHERE h1")
def freq_user(spark, folder):
    return he.user_frequency(sec_events(spark, folder, burst=True)).select("eventId", "user_count")


@query("q_freq_ip", f"WITH {HIST_BURST} SELECT eventId, n_ip AS ip_count FROM flags WHERE h2")
def freq_ip(spark, folder):
    return he.ip_frequency(sec_events(spark, folder, burst=True)).select("eventId", "ip_count")


@query("q_failed_login", f"WITH {HIST_BURST} SELECT eventId, CAST(n_fail AS BIGINT) AS failed_count FROM flags WHERE h3")
def failed_login(spark, folder):
    return he.failed_logins(sec_events(spark, folder, burst=True)).select("eventId", "failed_count")


@query("q_new_location", f"WITH {HIST} SELECT eventId, country AS new_country FROM flags WHERE h4")
def new_location(spark, folder):
    return he.new_locations(sec_events(spark, folder)).select("eventId", "new_country")


@query("q_unusual_action", f"WITH {HIST} SELECT eventId, name AS new_action FROM flags WHERE h5")
def unusual_action(spark, folder):
    return he.unusual_actions(sec_events(spark, folder)).select("eventId", "new_action")


@query("q_unusual_accessor", f"WITH {HIST} SELECT eventId, username AS new_accessor FROM flags WHERE h6")
def unusual_accessor(spark, folder):
    return he.unusual_accessors(sec_events(spark, folder)).select("eventId", "new_accessor")


@query("q_unusual_time", f"""
WITH {sec()}, n AS (SELECT *, isodow(ts) >= 6 AS w, hour(ts) >= 22 OR hour(ts) < 6 AS g, hour(ts) >= 2 AND hour(ts) < 5 AS e FROM sec)
SELECT eventId, concat_ws('|', CASE WHEN w THEN 'Activity during weekend' END,
    CASE WHEN g THEN 'Activity during unusual hours (' || lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00)' END,
    CASE WHEN e THEN 'Activity during very early morning hours' END) AS indicators,
  CASE WHEN e THEN 0.6 WHEN g THEN 0.4 ELSE 0.3 END::DOUBLE AS score
FROM n WHERE w OR g OR e""")
def unusual_time(spark, folder):
    events = sec_events(spark, folder).withColumn(
        "h", he.heuristic_result(F.array_compact(F.array(*he.time_entries()))))
    return events.where("h.isSuspicious").select(
        "eventId", F.array_join("h.indicators", "|").alias("indicators"), F.col("h.score").alias("score"))


@query("q_sensitive_op", f"WITH {sec()} SELECT eventId, {KEYWORD} AS keyword FROM sec WHERE {KEYWORD} IS NOT NULL")
def sensitive_op(spark, folder):
    events = sec_events(spark, folder).withColumn("keyword", he.sensitive_keyword(F.col("eventName")))
    return events.where("keyword is not null").select("eventId", "keyword")


@query("q_critical_resource", f"WITH {sec()} SELECT eventId, resource FROM sec WHERE criticality IN ('high','critical')")
def critical_resource(spark, folder):
    return sec_events(spark, folder).where(he.critical_resource()).select(
        "eventId", F.col("resource.resourceId").alias("resource"))


@query("q_user_baseline", f"""
WITH {sec()}, h AS (SELECT username, hour(ts) AS hr, count(*) AS n FROM sec GROUP BY 1, 2),
hh AS (SELECT username, string_agg(hr || ':' || n, '|' ORDER BY hr) AS hours FROM h GROUP BY 1)
SELECT s.username AS "user", array_to_string(list_sort(list(DISTINCT name)), '|') AS actions,
  array_to_string(list_sort(list(DISTINCT country)), '|') AS countries, count(*) AS n_events, any_value(hours) AS hours
FROM sec s JOIN hh USING (username) GROUP BY 1""")
def user_baseline(spark, folder):
    table = he.user_baseline(sec_events(spark, folder))
    pairs = F.transform("hours", lambda n, h: F.when(n > 0, F.concat(h.cast("string"), F.lit(":"), n.cast("string"))))
    return table.select("user", F.array_join("actions", "|").alias("actions"), F.array_join("countries", "|").alias("countries"),
                        "n_events", F.array_join(F.array_compact(pairs), "|").alias("hours"))


@query("q_resource_baseline", f"""
WITH {sec()} SELECT resource AS "resourceId", count(*) AS access_count, count(DISTINCT username) AS n_users,
  min(username) AS first_user, max(username) AS last_user FROM sec GROUP BY 1""")
def resource_baseline(spark, folder):
    return he.resource_baseline(sec_events(spark, folder))


@query("q_user_rollup", f"""
WITH {sec()}, h AS (SELECT username, hour(ts) AS hr, count(*) AS n FROM sec GROUP BY 1, 2),
hh AS (SELECT username, string_agg(hr || ':' || n, '|' ORDER BY hr) AS hours FROM h GROUP BY 1)
SELECT s.username AS "user", count(*) AS n_events, any_value(hours) AS hours, TRUE AS actions_close, TRUE AS countries_close,
  TRUE AS median_close FROM sec s JOIN hh USING (username) WHERE s.username IS NOT NULL GROUP BY 1""")
def user_rollup(spark, folder):
    """Merged days: exact counts as they are; sketches by whether they are within their error of the exact tables."""
    events = sec_events(spark, folder)
    merged = ro.merged_users(land(ro.user_days(events)), (0.5,)).withColumn("median", F.col("hour_quantiles")[0])
    exact = he.user_baseline(events).select("user", F.size("actions").alias("actions"), F.size("countries").alias("countries"))
    # the median's rank among the active hours' counts: the share below it and the share up to it
    hours = he.period_counts(events, he.HOUR_US).join(merged.select("user", "median"), "user").groupBy("user").agg(
        F.avg((F.col("n") < F.col("median")).cast("int")).alias("below"), F.avg((F.col("n") <= F.col("median")).cast("int")).alias("upto"))
    pairs = F.transform("hours", lambda n, h: F.when(n > 0, F.concat(h.cast("string"), F.lit(":"), n.cast("string"))))
    return merged.join(exact, "user").join(hours, "user").select(
        "user", "n_events", F.array_join(F.array_compact(pairs), "|").alias("hours"),
        ro.close(F.col("n_actions"), F.col("actions")).alias("actions_close"),
        ro.close(F.col("n_countries"), F.col("countries")).alias("countries_close"),
        ((F.col("below") <= 0.55) & (F.col("upto") >= 0.45)).alias("median_close"))


@query("q_resource_rollup", f"""
WITH {sec()} SELECT resource AS "resourceId", count(*) AS access_count, TRUE AS users_close FROM sec WHERE resource IS NOT NULL GROUP BY 1""")
def resource_rollup(spark, folder):
    events = sec_events(spark, folder)
    exact = he.resource_baseline(events).select("resourceId", F.col("n_users").alias("users"))
    return ro.merged_resources(land(ro.resource_days(events))).join(exact, "resourceId").select(
        "resourceId", "access_count", ro.close(F.col("n_users"), F.col("users")).alias("users_close"))


@query("q_baseline_score", f"""
WITH {HIST} SELECT eventId, CASE WHEN h4 THEN country END AS new_country, CASE WHEN h5 THEN name END AS new_action,
  CASE WHEN h6 THEN username END AS new_accessor
FROM flags WHERE (h4 OR h5 OR h6) AND ts >= TIMESTAMP '2024-01-08'""")
def baseline_score(spark, folder):
    """A baseline of the first week, then the rest scored against it and what it adds."""
    events = sec_events(spark, folder)
    cut = F.lit("2024-01-08").cast("timestamp")
    past, fresh = events.where(F.col("timestamp") < cut), events.where(F.col("timestamp") >= cut)
    tables = [
        he.new_locations(fresh, land(he.country_pairs(past)), cut),
        he.unusual_actions(fresh, land(he.action_pairs(past)), cut),
        he.unusual_accessors(fresh, land(he.accessor_pairs(past)), cut),
    ]
    return he.combine_signals(tables).select("eventId", "new_country", "new_action", "new_accessor")


HEURISTIC = "SELECT eventId, array_to_string(indicators, '|') AS indicators, round(hscore, 6) AS score FROM det WHERE by_heur"


def _heuristic(spark, folder, burst):
    events = sec_events(spark, folder, burst=burst)
    judged = he.with_heuristics(events, he.history_signals(events)).where("heuristic.isSuspicious")
    return judged.select("eventId", F.array_join("heuristic.indicators", "|").alias("indicators"),
                         F.round("heuristic.score", 6).alias("score"))


@query("q_heuristic", f"WITH {detected(third=False)} {HEURISTIC}")
def heuristic(spark, folder):
    return _heuristic(spark, folder, False)


@query("q_heuristic_burst", f"WITH {detected(True, third=False)} {HEURISTIC}")
def heuristic_burst(spark, folder):
    return _heuristic(spark, folder, True)


def _rolling(width_us: int, periods: int, threshold: str, label: str, measure: str, value: str) -> str:
    return f"""
WITH {sec()}, c AS (SELECT username AS "user", t_us // {width_us} AS p, count(*) AS n FROM sec GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER o AS s1, sum(n * n) OVER o AS s2 FROM c
  WINDOW o AS (PARTITION BY "user" ORDER BY p RANGE BETWEEN {periods} PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, s1 / CAST({periods} AS DOUBLE) AS mean, sqrt(({periods} * s2 - s1 * s1) / CAST({periods * periods} AS DOUBLE)) AS sd
  FROM w WHERE s1 IS NOT NULL)
SELECT "user", p * {width_us} AS {label}, n, round({value}, 6) AS {measure} FROM v WHERE sd > 0 AND abs((n - mean) / sd) > {threshold}"""


@query("q_zscore", _rolling(3_600_000_000, 24, "3.0", "hour_us", "z", "(n - mean) / sd"))
def zscore(spark, folder):
    return he.zscore_outliers(sec_events(spark, folder)).select("user", F.unix_micros("hour").alias("hour_us"), "n", "z")


@query("q_deviation", _rolling(86_400_000_000, 7, "2.5", "day_us", "deviation", "abs(n - mean) / sd"))
def deviation(spark, folder):
    return he.baseline_deviations(sec_events(spark, folder)).select(
        "user", F.unix_micros("day").alias("day_us"), "n", "deviation")


@query("q_features", f"WITH {sec()} SELECT eventId, {FEATURE_SQL} FROM sec")
def feature_rows(spark, folder):
    return an.features(sec_events(spark, folder)).drop("sourceProvider", "timestamp")


SCALED_SQL = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 4) AS {c}"
    for c in an.FEATURES
)


@query("q_scaled_features", f"WITH {sec()}, f AS (SELECT eventId, {FEATURE_SQL} FROM sec) SELECT eventId, {SCALED_SQL} FROM f")
def scaled_features(spark, folder):
    table = an.features(sec_events(spark, folder))
    scaled = an.scale(table, an.fit_scaler(table))
    return scaled.select("eventId", *[F.round(c, 4).alias(c) for c in an.FEATURES])


@query("q_forest_model")
def forest_model(spark, folder):
    return an.train(sec_events(spark, folder)).nodes


@query("q_anomaly")
def anomaly(spark, folder):
    events = sec_events(spark, folder)
    judged = an.with_anomaly(events, an.train(events)).where("anomaly.isAnomaly")
    return judged.select("eventId", F.round("anomaly.score", 6).alias("score"),
                         F.array_join("anomaly.reasons", "|").alias("reasons"))


@query("q_anomaly_fixed", f"""
WITH {detected(history=False)} SELECT eventId, round(raw, 6) AS raw, round(ascore, 6) AS score, anom AS anomalous, array_to_string(areasons, '|') AS reasons FROM det""")
def anomaly_fixed(spark, folder):
    """Every event's walk through a forest of fixed nodes."""
    events, model = sec_events(spark, folder), fixed_model(spark)
    judged = an.with_anomaly(events, model).withColumn("raw", an.isolation_score(model))
    return judged.select("eventId", F.round("raw", 6).alias("raw"), F.round("anomaly.score", 6).alias("score"),
                         F.col("anomaly.isAnomaly").alias("anomalous"), F.array_join("anomaly.reasons", "|").alias("reasons"))


@query("q_anomaly_reasons", f"""
WITH {sec()}, r AS (SELECT eventId, list_filter([
  CASE WHEN k / CAST(100 AS DOUBLE) > 0.9 THEN 'Highly unusual event pattern' WHEN k / CAST(100 AS DOUBLE) > 0.8 THEN 'Unusual event characteristics' END,
  CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'Activity during unusual hours' END,
  CASE WHEN risk > 0.7 THEN 'High risk score' END,
  CASE WHEN k % 10 = 0 THEN 'Threat indicators present: 1' END], lambda x: x IS NOT NULL) AS l FROM sec)
SELECT eventId, CASE WHEN len(l) > 0 THEN array_to_string(l, '|') ELSE 'Anomalous feature combination' END AS reasons FROM r""")
def reasons(spark, folder):
    k = F.col("network.source_port") - 1024
    events = sec_events(spark, folder).withColumn(
        "threatIndicators", F.when(k % 10 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")))
    return events.select("eventId", F.array_join(an.anomaly_reasons(k / F.lit(100.0)), "|").alias("reasons"))


@query("q_rule_score", f"WITH {detected(history=False, third=False)} SELECT eventId, rscore AS score FROM det WHERE by_rules")
def rule_scores(spark, folder):
    events = with_matched_rules(sec_events(spark, folder), load_rules()).where(F.size("matchedRules") > 0)
    return events.select("eventId", rule_score(F.col("matchedRules")).alias("score"))


@query("q_overall_score", f"""
WITH {detected()} SELECT eventId, round(overall, 6) AS score, threat, array_to_string(methods, '|') AS methods FROM det""")
def overall_scores(spark, folder):
    fused = detect(sec_events(spark, folder), load_rules(), fixed_model(spark))
    return fused.select("eventId", F.round("overallScore", 6).alias("score"), F.col("overallThreatDetected").alias("threat"),
                        F.array_join("detectionMethods", "|").alias("methods"))


@query("q_result_record", f"""
WITH {detected()} SELECT eventId, CAST(threat AS VARCHAR) AS threat, len(hits) AS n_rules, CAST(anom AS VARCHAR) AS anomalous, array_to_string(areasons, '|') AS reasons,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts FROM det""")
def result_records(spark, folder):
    records = result_record(detect(sec_events(spark, folder), load_rules(), fixed_model(spark)))
    reasons = F.from_json(F.get_json_object("record", "$.anomalyResult.reasons"), "array<string>")
    return records.select(
        F.get_json_object("record", "$.eventId").alias("eventId"),
        F.get_json_object("record", "$.overallThreatDetected").alias("threat"),
        F.json_array_length(F.get_json_object("record", "$.matchedRules")).alias("n_rules"),
        F.get_json_object("record", "$.anomalyResult.isAnomaly").alias("anomalous"), F.array_join(reasons, "|").alias("reasons"),
        F.get_json_object("record", "$.timestamp").alias("ts"))
