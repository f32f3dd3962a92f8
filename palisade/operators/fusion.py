"""Fusing rule, anomaly and heuristic results into one score per event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule severity weights and the two weights of the overall score.
RULE_WEIGHTS = {"critical": 1.0, "high": 0.8, "medium": 0.6, "low": 0.4, "info": 0.2}
OTHER_WEIGHT = 0.5
MAX_WEIGHT, MEAN_WEIGHT = 0.6, 0.4
METHODS = ["rules", "anomaly", "heuristic"]


def rule_weight(severity: Column) -> Column:
    weight = F.lit(OTHER_WEIGHT)
    for name, value in RULE_WEIGHTS.items():
        weight = F.when(severity == name, F.lit(value)).otherwise(weight)
    return weight


def rule_score(matched: Column) -> Column:
    """Highest weight among the matched rules; null when none matched."""
    return F.array_max(F.transform(matched, lambda r: rule_weight(r["severity"])))


def overall_score(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + s)
    blended = F.array_max(scores) * F.lit(MAX_WEIGHT) + (total / F.size(scores)) * F.lit(MEAN_WEIGHT)
    return F.when(F.size(scores) > 0, blended).otherwise(F.lit(0.0))


def fuse(df: DataFrame) -> DataFrame:
    """Needs ``matchedRules``, ``anomaly`` and ``heuristic``; adds methods, score and verdict."""
    fired = {
        "rules": (F.size("matchedRules") > 0, rule_score(F.col("matchedRules"))),
        "anomaly": (F.col("anomaly.isAnomaly"), F.col("anomaly.score")),
        "heuristic": (F.col("heuristic.isSuspicious"), F.col("heuristic.score")),
    }
    scores = F.array_compact(F.array(*[F.when(fired[m][0], fired[m][1]) for m in METHODS]))
    methods = F.array_compact(F.array(*[F.when(fired[m][0], F.lit(m)) for m in METHODS]))
    return (
        df.withColumn("engine_scores", scores)
        .withColumn("detectionMethods", methods)
        .withColumn("overallScore", overall_score(F.col("engine_scores")))
        .withColumn("overallThreatDetected", F.size("engine_scores") > 0)
        .drop("engine_scores")
    )


def result_record(df: DataFrame) -> DataFrame:
    """The exported detection result, one JSON record per event."""
    record = F.struct(
        F.col("eventId").alias("eventId"),
        F.transform("matchedRules", lambda r: F.struct(r["id"].alias("id"), r["name"].alias("name"),
                                                       r["severity"].alias("severity"))).alias("matchedRules"),
        F.col("anomaly").alias("anomalyResult"),
        F.col("heuristic").alias("heuristicResult"),
        "overallThreatDetected", "overallScore", "detectionMethods",
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )
    return df.select("eventId", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))
