"""Counters and reports as ordinary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.operators.normalize import at, is_valid, known_source


def stage_counts(raw: DataFrame, events: DataFrame, alerts_with_outcome: DataFrame) -> DataFrame:
    """Ingested, normalised and processed events; alerts by end state, as (stage, n) rows."""
    def counted(df: DataFrame, **stages: Column) -> DataFrame:
        totals = df.agg(*[F.count_if(c).alias(s) for s, c in stages.items()])
        pairs = [F.struct(F.lit(s).alias("stage"), F.col(s).alias("n")) for s in stages]
        return totals.select(F.explode(F.array(*pairs)).alias("p")).select("p.stage", "p.n")

    always = F.lit(True)
    return (
        counted(raw, events_ingested=always)
        .unionByName(counted(events, events_normalized=always, events_processed=is_valid()))
        .unionByName(counted(
            alerts_with_outcome,
            alerts_generated=always,
            alerts_dispatched=F.col("outcome") == "dispatched",
            alerts_deduplicated=F.col("outcome") == "deduplicated",
            alerts_throttled=F.col("outcome") == "throttled",
        ))
    )


def error_counts(raw: DataFrame, events: DataFrame) -> DataFrame:
    """Records that no projection knows and events that failed validation."""
    unknown = raw.where(~known_source()).agg(F.count("*").alias("n")).select(F.lit("normalization").alias("component"), "n")
    invalid = events.where(~is_valid()).agg(F.count("*").alias("n")).select(F.lit("validation").alias("component"), "n")
    return unknown.unionByName(invalid)


def detections_by_method(fused: DataFrame) -> DataFrame:
    return fused.select(F.explode("detectionMethods").alias("method")).groupBy("method").agg(F.count("*").alias("n"))


def detections_by_severity(fused: DataFrame) -> DataFrame:
    """By the event's severity; an event with two methods counts twice."""
    return (
        fused.where("overallThreatDetected").groupBy("severity")
        .agg(F.sum(F.size("detectionMethods")).alias("n"))
    )


def threat_rate(fused: DataFrame, group: str) -> DataFrame:
    """Events, threats and rate per source, with an 'all' row; sources without threats stay."""
    per = fused.groupBy(F.col(group).alias("source_file")).agg(
        F.count("*").alias("events"), F.count_if("overallThreatDetected").alias("threats"))
    total = per.agg(F.lit("all").alias("source_file"), F.sum("events").alias("events"), F.sum("threats").alias("threats"))
    rate = F.when(F.col("events") > 0, F.round(F.col("threats") / F.col("events") * 100, 1)).otherwise(F.lit(0.0))
    return per.unionByName(total).withColumn("rate", rate)


def latency_stats(df: DataFrame, start: str, end: str) -> DataFrame:
    """Average, smallest and largest end - start in ms, and events per second; 0 when empty."""
    took = F.unix_micros(end) - F.unix_micros(start)
    totals = df.agg(
        F.count("*").alias("n"), F.sum(took).alias("total"), F.min(took).alias("low"), F.max(took).alias("high"),
        (F.unix_micros(F.max(end)) - F.unix_micros(F.min(start))).alias("span"))
    zero = F.lit(0.0)
    return totals.select(
        F.col("n").alias("events"),
        F.round(F.coalesce(F.try_divide(F.col("total"), F.col("n")) / 1000, zero), 6).alias("avg_ms"),
        F.coalesce(F.col("low") / 1000, zero).alias("min_ms"),
        F.coalesce(F.col("high") / 1000, zero).alias("max_ms"),
        F.round(F.coalesce(F.try_divide(F.col("n") * 1000000.0, F.col("span")), zero), 6).alias("events_per_second"),
    )


def progress_stats(progress: list[dict]) -> dict[str, float]:
    """The same figures for a running stream, from its recent progress reports; 0 when idle."""
    busy = [p for p in progress if p["numInputRows"] > 0]
    took = [p["durationMs"]["triggerExecution"] for p in busy]
    rows = sum(p["numInputRows"] for p in busy)
    return {
        "events": rows,
        "avg_ms": sum(took) / rows if rows else 0.0,
        "min_ms": min((t / p["numInputRows"] for t, p in zip(took, busy)), default=0.0),
        "max_ms": max((t / p["numInputRows"] for t, p in zip(took, busy)), default=0.0),
        "events_per_second": rows * 1000.0 / sum(took) if sum(took) else 0.0,
    }


def engine_statistics(rules: DataFrame, anomaly_enabled: bool, heuristic_enabled: bool) -> DataFrame:
    """Rules loaded and enabled, and which other engines run."""
    return rules.agg(
        F.count("*").alias("rules_loaded"), F.count_if("enabled").alias("rules_enabled"),
        F.lit(anomaly_enabled).alias("anomaly_detector_enabled"),
        F.lit(heuristic_enabled).alias("heuristic_detector_enabled"))


def period_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("timestamp", width).alias("w")).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("period"), "n")


def sliding_counts(events: DataFrame, key: str, width: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Counts per key in overlapping windows; works on batch and streaming frames."""
    return events.groupBy(F.window("timestamp", width, slide).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("window_start"), key, "n")


def _scalar(path: str) -> Column:
    """Text at a path, but not the JSON of an object found there."""
    value = F.nullif(at(path), F.lit(""))
    return F.when(~value.startswith("{"), value)


def display_event() -> Column:
    return F.coalesce(_scalar("eventName"), at("operationName.value"), _scalar("operationName"),
                      _scalar("protoPayload.methodName"), F.lit("Unknown"))


def display_user() -> Column:
    paths = ["userIdentity.userName", "userIdentity.type", "caller", "identity.userPrincipalName",
             "protoPayload.authenticationInfo.principalEmail"]
    return F.coalesce(*[F.nullif(at(p), F.lit("")) for p in paths], F.lit("Unknown"))
