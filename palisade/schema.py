"""The unified event: one fixed, typed row for every provider."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Closed vocabularies of the event model, in their natural order.
EVENT_TYPES = [
    "authentication", "authorization", "resource_access", "network_traffic", "configuration_change",
    "data_access", "security_alert", "administrative_action", "unknown",
]
SEVERITIES = ["info", "low", "medium", "high", "critical"]
OUTCOMES = ["success", "failure", "unknown"]

GEO = T.StructType([
    T.StructField("ip", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("isp", T.StringType()),
    T.StructField("organization", T.StringType()),
])

ACTOR = T.StructType([
    T.StructField("userId", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("email", T.StringType()),
    T.StructField("userType", T.StringType()),
    T.StructField("sessionId", T.StringType()),
    T.StructField("ipAddress", T.StringType()),
    T.StructField("userAgent", T.StringType()),
    T.StructField("geo_location", GEO),
])

RESOURCE = T.StructType([
    T.StructField("resourceId", T.StringType()),
    T.StructField("resourceType", T.StringType()),
    T.StructField("resourceName", T.StringType()),
    T.StructField("accountId", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
])

NETWORK = T.StructType([
    T.StructField("sourceIp", T.StringType()),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destinationIp", T.StringType()),
    T.StructField("destinationPort", T.IntegerType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("bytesSent", T.LongType()),
    T.StructField("bytesReceived", T.LongType()),
    T.StructField("packets", T.LongType()),
    T.StructField("action", T.StringType()),
])

ENRICHMENT = T.StructType([
    T.StructField("geo_ip", GEO),
    T.StructField("threatIntel", T.StructType([
        T.StructField("indicators_found", T.ArrayType(T.StringType())),
        T.StructField("threat_level", T.StringType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
    ])),
    T.StructField("asset_inventory", T.StructType([
        T.StructField("resource_id", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("criticality", T.StringType()),
        T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
        T.StructField("last_seen", T.TimestampType()),
    ])),
    T.StructField("dns", T.StructType([
        T.StructField("ip", T.StringType()),
        T.StructField("hostname", T.StringType()),
    ])),
])

EVENT = T.StructType([
    T.StructField("eventId", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("sourceProvider", T.StringType()),
    T.StructField("sourceService", T.StringType()),
    T.StructField("eventType", T.StringType()),
    T.StructField("eventName", T.StringType()),
    T.StructField("eventCategory", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("actor", ACTOR),
    T.StructField("resource", RESOURCE),
    T.StructField("network", NETWORK),
    T.StructField("action", T.StringType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("outcome_reason", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("requestParameters", T.VariantType()),
    T.StructField("responseElements", T.VariantType()),
    T.StructField("enrichment", ENRICHMENT),
    T.StructField("threatIndicators", T.ArrayType(T.StringType())),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("rawEvent", T.VariantType()),
    T.StructField("correlation_id", T.StringType()),
    T.StructField("ingestion_timestamp", T.TimestampType()),
    T.StructField("normalization_timestamp", T.TimestampType()),
])

# What identifies one event when narrow results are matched back to it.
EVENT_KEY = ["sourceProvider", "eventId", "timestamp"]


def typed_struct(fields: dict[str, Column], schema: T.StructType) -> Column:
    """A struct of ``schema`` with nulls for every field not given."""
    return F.struct(*[
        fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields
    ])


def severity_rank(severity: Column) -> Column:
    """info 0 … critical 4; null for anything else."""
    rank = F.lit(None).cast("int")
    for position, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, position).otherwise(rank)
    return rank


def conform(df: DataFrame) -> DataFrame:
    """Add the unified columns a source did not produce, in schema order."""
    present = set(df.columns)
    defaults = {
        "severity": F.lit("info"),
        "outcome": F.lit("unknown"),
        "threatIndicators": F.array().cast("array<string>"),
        "ingestion_timestamp": F.current_timestamp(),
        "normalization_timestamp": F.current_timestamp(),
    }
    columns = []
    for f in EVENT.fields:
        if f.name in present:
            columns.append(F.col(f.name))
        else:
            columns.append(defaults.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name))
    extra = [F.col(c) for c in df.columns if c not in set(EVENT.fieldNames())]
    return df.select(*columns, *extra)
