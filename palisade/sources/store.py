"""Event and alert tables: partitioned by day, kept for a limited time."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.schema import EVENT_KEY
from palisade.session import delete_folder, land

# Retention in days.
EVENT_DAYS, ALERT_DAYS = 90, 365


def write_events(events: DataFrame, folder: str, mode: str = "append") -> None:
    """By provider and day. Rows are rebalanced: a busy day gets as many writers as its size asks for, small ones share
    a file. ``overwrite`` replaces only the provider's days that the events touch."""
    dated = events.withColumn("date", F.to_date("timestamp")).hint("rebalance", "sourceProvider", "date")
    dated.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("sourceProvider", "date").parquet(folder)


def store_exists(spark: SparkSession, folder: str) -> bool:
    try:
        spark.read.parquet(folder).limit(0).collect()
        return True
    except AnalysisException:
        return False


def _flow_content(df: DataFrame) -> Column:
    """What tells flow records of one millisecond apart, which is all their id says; empty for other events. What a run
    adds (enrichment, its own times) is left out."""
    if "sourceService" not in df.columns:
        return F.lit("")
    said = [F.coalesce(F.to_json(c), F.lit("")) for c in ("network", "rawEvent") if c in df.columns]
    return F.when(F.col("sourceService") == "vpc_flow_logs", F.sha2(F.concat_ws("\x1f", *said), 256)).otherwise("")


def merge_events(events: DataFrame, folder: str) -> None:
    """Add events to the store; those delivered again replace their earlier copies, all others stay. Flow records count as
    delivered again if their content is the same too."""
    spark = events.sparkSession
    if not store_exists(spark, folder):
        return write_events(events, folder)
    events = land(events)
    touched = events.select(F.to_date("timestamp").alias("date")).distinct()
    stored = spark.read.parquet(folder).join(F.broadcast(touched), "date", "left_semi").drop("date")  # a row per day
    again = events.select(*EVENT_KEY, _flow_content(events).alias("flow_content")).distinct()
    kept = stored.withColumn("flow_content", _flow_content(stored)).join(again, [*EVENT_KEY, "flow_content"], "left_anti")
    write_events(land(kept.select(*events.columns).unionByName(events)), folder, mode="overwrite")


def write_alerts(alerts: DataFrame, folder: str, mode: str = "append") -> None:
    dated = alerts.withColumn("date", F.to_date("timestamp"))
    dated.write.mode(mode).partitionBy("date").parquet(folder)


def read_store(spark: SparkSession, folder: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates [start, end) of a stored table; only those partitions are read."""
    rows = spark.read.parquet(folder)
    if start:
        rows = rows.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        rows = rows.where(F.col("date") < F.lit(end).cast("date"))
    return rows


def retained(df: DataFrame, as_of: Column, days: int, column: str = "timestamp") -> DataFrame:
    """Rows young enough to keep."""
    return df.where(F.to_date(column) >= F.date_sub(as_of.cast("date"), days))


def expired_dates(spark: SparkSession, folder: str, as_of: Column, days: int) -> DataFrame:
    """Day partitions a retention job may drop."""
    return spark.read.parquet(folder).select("date").distinct().where(
        F.col("date") < F.date_sub(as_of.cast("date"), days))


def drop_expired(spark: SparkSession, folder: str, as_of: Column, days: int) -> list[str]:
    """Delete the day partitions that are older than the retention; returns their dates. No other file is touched."""
    table = spark.read.parquet(folder)
    parts = [c for c in ("sourceProvider", "date") if c in table.columns and c in folder_parts(table)]
    old = table.select(*parts).distinct().where(F.col("date") < F.date_sub(as_of.cast("date"), days)).collect()
    for row in old:  # a row per day and provider
        delete_folder(spark, "/".join([folder, *[f"{c}={row[c]}" for c in parts]]))
    return sorted({str(row["date"]) for row in old})


def folder_parts(table: DataFrame) -> list[str]:
    """Partition columns of a stored table, from one of its files' paths."""
    files = table.select(F.col("_metadata.file_path").alias("f")).limit(1).collect()
    return [p.split("=")[0] for p in files[0]["f"].split("/")[:-1] if "=" in p] if files else []
