"""Baselines from daily roll-ups: a day is read once, any range of days is merged from its small rows.

A row per day and owner holds exact counts and mergeable sketches: distinct users, actions and countries as HyperLogLog
(4 KB at most, about 1.6 % standard error, exact for a few values) and the counts of active hours as KLL quantiles (rank
error about 1.7 %). So a baseline over 90 days reads 90 rows an owner, whatever the number of events, and a popular
resource never has its users gathered. The exact tables are in ``heuristics``.

A day that is rolled up again replaces itself. Events without an owner or a time have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LG_K, QUANTILE_K = 12, 200
HOURS = [f"h{h}" for h in range(24)]


def _named(events: DataFrame) -> DataFrame:
    def said(path: str) -> Column:
        return F.nullif(F.col(path), F.lit(""))

    return events.where("timestamp is not null").select(
        F.to_date("timestamp").alias("date"), F.hour("timestamp").alias("hour"), "eventName",
        said("actor.username").alias("username"), said("actor.geo_location.country").alias("country"),
        said("resource.resourceId").alias("resourceId"))


def _sketch(column: str) -> Column:
    return F.hll_sketch_agg(column, F.lit(LG_K))


def user_days(events: DataFrame) -> DataFrame:
    """Per day and user: events, events by hour of day, sketches of actions, countries and counts of active hours."""
    rows = _named(events).where("username is not null")
    hourly = rows.groupBy("date", F.col("username").alias("user"), "hour").agg(
        F.count("*").alias("n"), _sketch("eventName").alias("actions"), _sketch("country").alias("countries"))
    return hourly.groupBy("date", "user").agg(
        F.sum("n").alias("n_events"),
        *[F.sum(F.when(F.col("hour") == h, F.col("n")).otherwise(0)).alias(name) for h, name in enumerate(HOURS)],
        F.hll_union_agg("actions").alias("actions"), F.hll_union_agg("countries").alias("countries"),
        F.kll_sketch_agg_bigint("n", F.lit(QUANTILE_K)).alias("hour_counts"))


def resource_days(events: DataFrame) -> DataFrame:
    """Per day and resource: accesses and a sketch of the users."""
    return _named(events).where("resourceId is not null").groupBy("date", "resourceId").agg(
        F.count("*").alias("access_count"), _sketch("username").alias("users"))


def write_days(days: DataFrame, folder: str) -> None:
    """Into the roll-up table; the days that are given replace their earlier rows, all others stay."""
    days.hint("rebalance", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(folder)


def read_days(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Days [start, end); only their partitions are read."""
    rows = spark.read.parquet(folder)
    if start is not None:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    return rows if end is None else rows.where(F.col("date") < F.lit(end).cast("date"))


def merged_users(days: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Per user over all days given: exact counts, about how many actions and countries, quantiles of the active hours' counts."""
    merged = days.groupBy("user").agg(
        F.sum("n_events").alias("n_events"), *[F.sum(h).alias(h) for h in HOURS],
        F.hll_union_agg("actions").alias("a"), F.hll_union_agg("countries").alias("c"),
        F.kll_merge_agg_bigint("hour_counts").alias("q"))
    return merged.select(
        "user", "n_events", F.array(*HOURS).alias("hours"), F.hll_sketch_estimate("a").alias("n_actions"),
        F.hll_sketch_estimate("c").alias("n_countries"),
        F.array(*[F.kll_sketch_get_quantile_bigint("q", F.lit(q)) for q in quantiles]).alias("hour_quantiles"))


def merged_resources(days: DataFrame) -> DataFrame:
    """Per resource over all days given: accesses, and about how many users."""
    return days.groupBy("resourceId").agg(
        F.sum("access_count").alias("access_count"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("n_users"))


def close(estimate: Column, exact: Column, share: float = 0.05) -> Column:
    """Within three standard errors of a distinct count."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * share)
