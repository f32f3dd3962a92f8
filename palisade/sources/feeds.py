"""Landed provider feeds as ``raw(source, source_file, body)`` rows."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.classify import log_level_rank
from palisade.operators.normalize import at, event_time, text_at

log = logging.getLogger(__name__)

# Source by sample file name, and the marks of the feeds.
FILE_SOURCES = {
    "aws_cloudtrail": "aws_cloudtrail",
    "aws_guardduty": "aws_guardduty",
    "azure_activity": "azure_activity_logs",
    "gcp_audit": "gcp_audit_logs",
}
AUDIT_LOG_MARK = "cloudaudit.googleapis.com"
FLOW_MIN_FIELDS = 14
FLOW_POSITIONS = {
    "account_id": 1, "interface_id": 2, "src_addr": 3, "dst_addr": 4, "src_port": 5, "dst_port": 6,
    "protocol": 7, "packets": 8, "bytes": 9, "action": 12,
}


# --- readers --------------------------------------------------------------------------------


def read_json_lines(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """One JSON record per line: the splittable form for large feeds. Bad lines stay as they are
    and fail validation later."""
    rows = spark.read.text(path).select(F.col("value").alias("body"), F.col("_metadata.file_name").alias("source_file"))
    return _tagged(rows, source)


def stream_json_lines(spark: SparkSession, path: str, source: str | None = None, **options: str) -> DataFrame:
    rows = spark.readStream.options(**options).text(path).select(
        F.col("value").alias("body"), F.col("_metadata.file_name").alias("source_file"))
    return _tagged(rows, source)


def read_json_arrays(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """Files holding one JSON array each (a provider delivers them in modest sizes)."""
    whole = spark.read.option("multiLine", True).option("singleVariantColumn", "v").option(
        "pathGlobFilter", "*.json").json(path).select("v", F.col("_metadata.file_name").alias("source_file"))
    rows = whole.lateralJoin(spark.tvf.variant_explode(F.col("v").outer())).select(
        F.to_json("value").alias("body"), "source_file")
    return _tagged(rows, source)


def file_source(file_name: Column) -> Column:
    source = F.lit(None).cast("string")
    for mark, name in FILE_SOURCES.items():
        source = F.when(file_name.contains(mark), F.lit(name)).otherwise(source)
    return source


def _tagged(rows: DataFrame, source: str | None) -> DataFrame:
    """A feed's declared source is a constant; otherwise the record's own, else the file name's."""
    named = F.lit(source) if source else F.coalesce(at("source"), file_source(F.col("source_file")))
    return rows.select(named.alias("source"), "source_file", "body")


# --- flow-log lines ------------------------------------------------------------------------


def parse_flow_lines(lines: DataFrame, message: str = "message", millis: str = "timestamp") -> DataFrame:
    """Whitespace-separated flow lines with at least 14 fields, by position."""
    parts = F.split(F.trim(F.col(message)), r"\s+")
    kept = lines.withColumn("__p", parts).where(F.size("__p") >= FLOW_MIN_FIELDS)
    return kept.select(F.col(millis).alias("timestamp"),
                       *[F.get("__p", F.lit(i)).alias(name) for name, i in FLOW_POSITIONS.items()],
                       F.col(message).alias("raw_message"))


def flow_raw(lines: DataFrame) -> DataFrame:
    """Flow lines as raw records for the normaliser."""
    parsed = parse_flow_lines(lines)
    return parsed.select(F.lit("aws_vpc_flow_logs").alias("source"), F.lit(None).cast("string").alias("source_file"),
                         F.to_json(F.struct(*parsed.columns)).alias("body"))


# --- provider records in collector shape -----------------------------------------------------


def cloudtrail_records(raw: DataFrame) -> DataFrame:
    """Wrapped look-up records; the event itself arrives as a JSON string."""
    return raw.select(
        F.lit("aws_cloudtrail").alias("source"),
        text_at("EventId").alias("eventId"), text_at("EventName").alias("eventName"),
        event_time("EventTime").alias("eventTime"), text_at("Username").alias("username"),
        at("Resources", "variant").alias("resources"),
        F.try_parse_json(F.coalesce(at("CloudTrailEvent"), F.lit("{}"))).alias("cloud_trail_event"),
        F.try_parse_json("body").alias("rawEvent"),
    )


def cloudtrail_raw(raw: DataFrame) -> DataFrame:
    """Wrapped look-up records in the shape the normaliser reads."""
    records = cloudtrail_records(raw).withColumn("eventTime", F.date_format("eventTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    names = ["eventId", "eventName", "eventTime", "username"]
    text = F.to_json(F.struct(*names, "resources", "cloud_trail_event"))
    return records.select("source", F.lit(None).cast("string").alias("source_file"), text.alias("body"))


def guardduty_findings(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    """Findings updated between the bounds, to the millisecond, both included."""
    updated = F.date_trunc("millisecond", event_time("updatedAt", "UpdatedAt"))
    return raw.where(updated.between(F.date_trunc("millisecond", start), F.date_trunc("millisecond", end)))


def azure_activity_records(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.lit("azure_activity_logs").alias("source"),
        event_time("event_timestamp", "eventTimestamp").alias("event_timestamp"),
        text_at("level").alias("level"),
        text_at("operation_name", "operationName.value").alias("operation_name"),
        text_at("resource_id", "resourceId").alias("resource_id"),
        text_at("resource_group", "resourceGroupName").alias("resource_group"),
        text_at("status.value", "status").alias("status"),
        text_at("caller").alias("caller"),
        text_at("correlation_id", "correlationId").alias("correlation_id"),
        text_at("description").alias("description"),
        text_at("event_data_id", "eventDataId").alias("event_data_id"),
        text_at("category.value", "category").alias("category"),
    )


def azure_security_alerts(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    return raw.where(event_time("time_generated").between(start, end))


def gcp_audit_entries(raw: DataFrame, start: Column, end: Column) -> DataFrame:
    """Audit entries of a time range; for the newest first take ``latest``, which sorts no whole feed."""
    log_name = text_at("log_name", "logName")
    return raw.where(log_name.contains(AUDIT_LOG_MARK) & event_time("timestamp").between(start, end))


def min_severity(df: DataFrame, level: Column, floor: str) -> DataFrame:
    """Entries at or above a log severity."""
    return df.where(log_level_rank(level) >= log_level_rank(F.lit(floor)))


def gcp_log_entries(raw: DataFrame, start: Column, end: Column, floor: str | None = None) -> DataFrame:
    """General log entries; the payload is text or an object, told apart by its type."""
    rows = raw.where(event_time("timestamp").between(start, end))
    if floor:
        rows = min_severity(rows, text_at("severity"), floor)
    payload = at("payload", "variant")
    shape = F.schema_of_variant(payload)
    return rows.select(
        F.lit("gcp_cloud_logging").alias("source"),
        text_at("log_name", "logName").alias("log_name"),
        event_time("timestamp").alias("timestamp"),
        text_at("severity").alias("severity"),
        at("resource", "variant").alias("resource"),
        F.coalesce(text_at("textPayload", "text_payload"), F.when(shape == "STRING", at("payload"))).alias("text_payload"),
        F.coalesce(at("jsonPayload", "variant"), at("json_payload", "variant"), F.when(shape.startswith("OBJECT"), payload)).alias("json_payload"),
        at("labels", "variant").alias("labels"),
        text_at("trace").alias("trace"), text_at("spanId", "span_id").alias("span_id"),
        text_at("insertId", "raw_entry.insertId").alias("insert_id"),
    )


# --- combining and cutting -------------------------------------------------------------------

READERS: dict[str, Callable[[SparkSession, str, str | None], DataFrame]] = {
    "json_lines": read_json_lines,
    "json_arrays": read_json_arrays,
}


def register_reader(name: str, reader: Callable[[SparkSession, str, str | None], DataFrame]) -> None:
    READERS[name] = reader


def read_feeds(spark: SparkSession, feeds: list[dict]) -> DataFrame:
    """Union of all feeds ({reader, path, source}); a feed that cannot be read is skipped."""
    merged: DataFrame | None = None
    for feed in feeds:
        try:
            rows = READERS[feed.get("reader", "json_lines")](spark, feed["path"], feed.get("source"))
            rows.schema  # resolves the path now, so a missing feed fails here
        except AnalysisException as error:
            log.warning("feed %s skipped: %s", feed.get("path"), error)
            continue
        merged = rows if merged is None else merged.unionByName(rows, allowMissingColumns=True)
    if merged is None:
        empty = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_file", T.StringType()),
                              T.StructField("body", T.StringType())])
        return spark.createDataFrame([], empty)
    return merged


def union_feeds(feeds: list[DataFrame]) -> DataFrame:
    merged = feeds[0]
    for feed in feeds[1:]:
        merged = merged.unionByName(feed, allowMissingColumns=True)
    return merged


def drop_redelivered(events: DataFrame) -> DataFrame:
    """The same event delivered by two feeds or two polls counts once. Flow records carry no id of
    their own (only their millisecond), so they are left alone."""
    flow = F.col("sourceService") == "vpc_flow_logs" if "sourceService" in events.columns else F.lit(False)
    flow = F.coalesce(flow, F.lit(False))
    return events.where(~flow).dropDuplicates(["sourceProvider", "eventId"]).unionByName(events.where(flow))


def time_range(df: DataFrame, start: Column | None = None, end: Column | None = None,
               column: str = "timestamp") -> DataFrame:
    """Half-open [start, end); the default is the hour up to now."""
    until = end if end is not None else F.lit(datetime.now(timezone.utc))
    since = start if start is not None else until - F.make_dt_interval(hours=F.lit(1))
    return df.where((F.col(column) >= since) & (F.col(column) < until))


def poll_bounds(last: datetime | None, now: datetime) -> tuple[datetime, datetime]:
    """The next polling range: from the last end, or one hour back at the first poll."""
    return (last or now - timedelta(hours=1)), now


def latest(df: DataFrame, n: int, column: str = "timestamp", tie: str = "eventId") -> DataFrame:
    """Newest first, ties by id: a top-n, not a full sort."""
    return df.orderBy(F.col(column).desc(), F.col(tie).asc()).limit(n)
