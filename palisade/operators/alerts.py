"""Building alerts from fused detection results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import first_nonempty, utc_text
from palisade.schema import SEVERITIES, severity_rank

# Score floors of the alert severities, and the fingerprint's shape.
SCORE_FLOORS = [(0.9, "critical"), (0.7, "high"), (0.5, "medium"), (0.3, "low")]
FINGERPRINT_INDICATORS, FINGERPRINT_CHARS = 5, 16
FIELD_MARK, ITEM_MARK = chr(31), chr(30)
STATUSES = ["new", "investigating", "resolved", "false_positive"]


def alert_severity(matched: Column, score: Column) -> Column:
    """Highest known severity among the matched rules, else the band of the score."""
    best = F.array_max(F.transform(matched, lambda r: severity_rank(r["severity"])))
    from_rules = F.get(F.array(*[F.lit(s) for s in SEVERITIES]), best)
    band = F.lit("info")
    for floor, name in reversed(SCORE_FLOORS):
        band = F.when(score >= floor, F.lit(name)).otherwise(band)
    return F.coalesce(from_rules, band)


def alert_title() -> Column:
    name = F.col("eventName")
    return F.coalesce(
        F.get("matchedRules", F.lit(0))["name"],
        F.when(F.col("anomaly.isAnomaly"), F.concat(F.lit("Anomalous Activity Detected: "), name)),
        F.when(F.col("heuristic.isSuspicious"), F.concat(F.lit("Suspicious Activity Detected: "), name)),
        F.concat(F.lit("Security Event: "), name),
    )


def _section(condition: Column, heading: str, lines: Column) -> Column:
    body = F.concat(F.array(F.lit(heading)), F.transform(lines, lambda x: F.concat(F.lit("- "), x)), F.array(F.lit("")))
    return F.when(condition, body).otherwise(F.array().cast("array<string>"))


def alert_description() -> Column:
    rule_lines = F.transform("matchedRules", lambda r: F.concat(r["name"], F.lit(": "), r["description"]))
    actor = first_nonempty(F.col("actor.username"), F.col("actor.userId"), F.lit("Unknown"))
    address = F.nullif(F.col("actor.ipAddress"), F.lit(""))
    closing = F.array_compact(F.array(
        F.concat(F.lit("**Event:** "), F.col("eventName")),
        F.concat(F.lit("**Source:** "), F.col("sourceProvider"), F.lit("/"), F.col("sourceService")),
        F.concat(F.lit("**Time:** "), utc_text(F.col("timestamp"))),
        F.when(F.col("actor").isNotNull(), F.concat(F.lit("**Actor:** "), actor)),
        F.when(address.isNotNull(), F.concat(F.lit("**IP Address:** "), address)),
    ))
    return F.array_join(F.concat(
        _section(F.size("matchedRules") > 0, "**Matched Rules:**", rule_lines),
        _section(F.col("anomaly.isAnomaly"), "**Anomaly Detection:**", F.col("anomaly.reasons")),
        _section(F.col("heuristic.isSuspicious"), "**Heuristic Analysis:**", F.col("heuristic.indicators")),
        closing,
    ), "\n")


def alert_indicators() -> Column:
    """Distinct indicators of the event and of the engines that fired, sorted."""
    nothing = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(
        F.coalesce(F.col("threatIndicators"), nothing),
        F.when(F.col("heuristic.isSuspicious"), F.col("heuristic.indicators")).otherwise(nothing),
        F.when(F.col("anomaly.isAnomaly"), F.col("anomaly.reasons")).otherwise(nothing),
    )))


def fingerprint(title: Column, severity: Column, methods: Column, indicators: Column) -> Column:
    """Alerts alike in title, severity, methods and leading indicators share it, whoever caused them."""
    text = F.concat_ws(
        FIELD_MARK, title, severity,
        F.array_join(F.array_sort(methods), ITEM_MARK),
        F.array_join(F.slice(F.array_sort(indicators), 1, FINGERPRINT_INDICATORS), ITEM_MARK),
    )
    return F.substring(F.sha2(text, 256), 1, FINGERPRINT_CHARS)


def build_alerts(fused: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """One alert per event judged a threat. All times are event times, so ids are repeatable.

    ``carry`` names event columns to keep next to the alert (for reports)."""
    alert_id = F.concat(F.lit("alert_"), F.col("eventId"), F.lit("_"), F.unix_seconds("timestamp").cast("string"))
    base = fused.where("overallThreatDetected").select(
        alert_id.alias("alertId"),
        alert_title().alias("title"),
        alert_description().alias("description"),
        alert_severity(F.col("matchedRules"), F.col("overallScore")).alias("severity"),
        "eventId",
        "detectionMethods",
        alert_indicators().alias("indicators"),
        "timestamp",
        F.lit(STATUSES[0]).alias("status"),
        F.struct("sourceProvider", "sourceService", "eventType", "eventName", "overallScore").alias("metadata"),
        *(carry or []),
    )
    mark = fingerprint(F.col("title"), F.col("severity"), F.col("detectionMethods"), F.col("indicators"))
    return base.withColumn("fingerprint", mark)
