"""Small unified events for tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palisade.schema import ACTOR, GEO, NETWORK, RESOURCE, conform, typed_struct

START = datetime(2024, 11, 13, 12, 0, 0)  # a Wednesday noon
COLUMNS = (
    "eventId string, offset_us long, sourceProvider string, sourceService string, eventType string, eventName string, "
    "severity string, username string, userId string, userType string, ip string, country string, resourceId string, "
    "criticality string, bytes long, risk double, outcome string, sip string, dip string"
)
DEFAULTS = dict(
    offset_us=0, sourceProvider="aws", sourceService="cloudtrail", eventType="resource_access", eventName="Look",
    severity="info", username=None, userId=None, userType=None, ip=None, country=None, resourceId=None, criticality=None,
    bytes=None, risk=None, outcome="success", sip=None, dip=None,
)
MINUTE = 60_000_000


def events(spark, rows, start=START):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    full = [
        tuple({**DEFAULTS, "eventId": f"e{i:05d}", **row}[n] for n in names) for i, row in enumerate(rows)
    ]
    df = spark.createDataFrame(full, COLUMNS)
    base = int((start - datetime(1970, 1, 1)) / timedelta(microseconds=1))
    geo = F.when(F.col("country").isNotNull(), typed_struct({"country": F.col("country")}, GEO))
    return conform(df.select(
        "eventId", F.timestamp_micros(F.lit(base) + F.col("offset_us")).alias("timestamp"), "sourceProvider", "sourceService",
        "eventType", "eventName", "severity",
        typed_struct({"username": F.col("username"), "userId": F.col("userId"), "userType": F.col("userType"),
                      "ipAddress": F.col("ip"), "geo_location": geo}, ACTOR).alias("actor"),
        F.when(F.col("resourceId").isNotNull(), typed_struct({
            "resourceId": F.col("resourceId"),
            "tags": F.when(F.col("criticality").isNotNull(), F.create_map(F.lit("criticality"), F.col("criticality"))),
        }, RESOURCE)).alias("resource"),
        typed_struct({"bytesSent": F.col("bytes"), "sourceIp": F.col("sip"), "destinationIp": F.col("dip")}, NETWORK).alias("network"),
        F.col("risk").alias("risk_score"), "outcome",
    ))


def ids(df, column="eventId"):
    return sorted(r[column] for r in df.collect())
