"""Unified events derived from the generic ``events`` table (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.classify import classify_aws, classify_gcp
from palisade.schema import ACTOR, GEO, NETWORK, RESOURCE, conform, typed_struct
from palisade.session import read_table, spread

# The event names, countries and addresses of the derived event stream.
CLICK_NAMES = ["GetObject", "ListBuckets", "GetSecretValue", "DescribeInstances", "GetPasswordData", "ListUsers"]
VIEW_NAMES = ["DescribeVpcs", "GetBucketPolicy", "ListKeys", "DescribeTrails"]
PURCHASE_NAMES = [
    "CreateAccessKey", "DeleteTrail", "AttachUserPolicy", "AuthorizeSecurityGroupIngress",
    "TerminateInstances", "UpdateFunction", "DeleteBucket", "PutRolePolicy",
]
COUNTRIES = ["US", "CA", "GB", "DE", "FR", "RU", "CN", "BR"]
STREAM_START_US = 1704067200000000  # 2024-01-01T00:00:00Z
COMPRESSION = 1440  # one day becomes one minute


def _pick(names: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(n) for n in names]), index.cast("int"))


def base_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The events table with ``k`` read from its JSON column and time as a UTC timestamp."""
    return spread(read_table(spark, folder, "events")).select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        "props",
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


def sec_events(spark: SparkSession, folder: str, burst: bool = False) -> DataFrame:
    """Unified events; ``burst`` compresses time and users so trailing counts fire."""
    rows = base_columns(spark, folder)
    event_type, k = F.col("event_type"), F.col("k")
    names = (
        F.when(event_type.isin("signup", "error"), F.lit("ConsoleLogin"))
        .when(event_type == "click", _pick(CLICK_NAMES, k % 6))
        .when(event_type == "view", _pick(VIEW_NAMES, k % 4))
        .otherwise(_pick(PURCHASE_NAMES, k % 8))
    )
    user = F.col("user_id")
    address = user % 20
    if burst:
        us = F.unix_micros("timestamp")
        squeezed = F.lit(STREAM_START_US) + F.floor((us - STREAM_START_US) / COMPRESSION).cast("long")
        rows = rows.withColumn("timestamp", F.timestamp_micros(squeezed))
        names = (
            F.when(event_type.isin("signup", "error"), F.lit("ConsoleLogin"))
            .when(event_type == "click", F.lit("GetObject"))
            .when(event_type == "view", F.lit("DescribeInstances"))
            .otherwise(F.lit("CreateAccessKey"))
        )
        user, address = F.col("user_id") % 10, F.col("user_id") % 6
    rows = rows.withColumn("eventName", names)
    provider = _pick(["aws", "azure", "gcp"], F.col("event_id") % 3)
    trail = (
        F.when(provider == "aws", F.lit("cloudtrail"))
        .when(provider == "azure", F.lit("activityLogs"))
        .otherwise(F.lit("gcp_audit_logs"))
    )
    country = _pick(COUNTRIES, (F.col("user_id") + F.when(F.col("event_id") % 53 == 0, 3).otherwise(0)) % 8)
    actor = typed_struct({
        "username": F.concat(F.lit("user_"), user.cast("string")),
        "userType": F.when(F.col("user_id") % 50 == 0, "Root").otherwise("IAMUser"),
        "ipAddress": F.concat(F.lit("203.0.113."), address.cast("string")),
        "geo_location": typed_struct({"country": country}, GEO),
    }, ACTOR)
    resource = typed_struct({
        "resourceId": F.concat(F.lit("res-"), (k % 25).cast("string")),
        "tags": F.create_map(F.lit("criticality"), F.when(k % 25 == 7, "high").otherwise("low")),
    }, RESOURCE)
    network = typed_struct({
        "sourceIp": F.concat(F.lit("198.51.100."), (k % 10).cast("string")),
        "source_port": k + 1024,
        "destinationIp": F.concat(F.lit("192.0.2."), (k % 20).cast("string")),
        "destinationPort": F.when(k % 2 == 0, 443).otherwise(22),
        "bytesSent": F.floor(F.col("value") * 100000000).cast("long"),
    }, NETWORK)
    return conform(rows.select(
        F.concat(F.lit("evt-"), F.col("event_id").cast("string")).alias("eventId"),
        "timestamp",
        provider.alias("sourceProvider"),
        F.when(k == 99, F.lit("guardduty")).otherwise(trail).alias("sourceService"),
        F.when(provider == "aws", classify_aws(F.col("eventName")))
        .when(provider == "gcp", classify_gcp(F.col("eventName")))
        .otherwise("administrative_action").alias("eventType"),
        "eventName",
        F.when(k >= 95, "critical").when(k >= 85, "high").when(k >= 70, "medium")
        .when(k >= 50, "low").otherwise("info").alias("severity"),
        actor.alias("actor"),
        resource.alias("resource"),
        network.alias("network"),
        F.col("eventName").alias("action"),
        F.when(event_type == "error", "failure").otherwise("success").alias("outcome"),
        F.to_variant_object(F.struct((k % 2 == 0).alias("mfaUsed"))).alias("requestParameters"),
        F.when(k >= 95, k.cast("double") / F.lit(100.0)).alias("risk_score"),
    ))


RAW_SOURCES = [
    "aws_cloudtrail", "aws_guardduty", "aws_vpc_flow_logs", "azure_activity_logs", "azure_security_center",
    "gcp_audit_logs", "gcp_cloud_logging", "onprem_syslog",
]
AZURE_LEVELS = ["Critical", "Error", "Warning", "Informational", "Verbose"]
ALERT_LEVELS = ["High", "Medium", "Low", "Informational", "Other"]
LOG_LEVELS = ["DEFAULT", "DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY"]
METHODS = ["v1.compute.instances.insert", "storage.buckets.create", "SetIamPolicy", "projects.list", "UserLogin", "x.delete"]


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Provider-shaped JSON records, one per event: nested and flat shapes, missing and bad values."""
    rows = base_columns(spark, folder)
    k, event = F.col("k"), F.col("event_id")
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    time = F.when(k == 13, F.lit("not a time")).otherwise(iso)
    ident = F.concat(F.lit("raw-"), event.cast("string"))
    user = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    failed = F.col("event_type") == "error"

    def record(**fields: Column) -> Column:
        return F.struct(*[v.alias(n) for n, v in fields.items()])

    trail = record(
        eventID=ident, eventTime=time, eventName=_pick(PURCHASE_NAMES, k % 8),
        userIdentity=record(type=F.lit("IAMUser"), principalId=F.concat(F.lit("P"), F.col("user_id").cast("string")),
                            userName=F.when(k % 10 != 0, user),
                            sessionContext=record(sessionIssuer=record(userName=F.when(k % 3 == 0, F.lit("role"))))),
        sourceIPAddress=F.concat(F.lit("203.0.113."), (F.col("user_id") % 20).cast("string")),
        errorCode=F.when(failed, "AccessDenied").when(k % 9 == 0, ""), errorMessage=F.when(failed, "denied"),
        recipientAccountId=F.lit("123456789012"), requestParameters=record(mfaUsed=k % 2 == 0),
    )
    resources = F.when(k % 4 != 0, F.array(record(
        ARN=F.concat(F.lit("arn:res-"), (k % 25).cast("string")), ResourceType=F.lit("AWS::S3::Bucket"),
        ResourceName=F.concat(F.lit("res-"), (k % 25).cast("string")))))
    wrapped = F.to_json(record(cloud_trail_event=trail, eventName=F.lit("Outer"), username=F.lit("outer_user"), resources=resources))
    flat_trail = F.to_json(record(**{n: trail[n] for n in (
        "eventID", "eventTime", "eventName", "userIdentity", "sourceIPAddress", "errorCode", "errorMessage",
        "recipientAccountId", "requestParameters")}, username=F.lit("outer_user"), resources=resources))
    finding = record(
        id=F.when(k % 2 == 0, ident), finding_id=F.when(k % 2 != 0, ident), updatedAt=time,
        type=F.concat(F.lit("Recon:EC2/"), F.col("event_type")), description=F.lit("finding"),
        severity=F.when((k % 17 != 0) & (k % 19 != 0), k.cast("double") / 10),
        service=record(action=record(
            actionType=F.when(k % 2 == 0, "NETWORK_CONNECTION").otherwise("AWS_API_CALL"),
            networkConnectionAction=record(remoteIpDetails=record(ipAddressV4=F.concat(F.lit("198.51.100."), (k % 10).cast("string"))),
                                           localPortDetails=record(port=k), protocol=F.lit("TCP")))),
    )
    textual = F.to_json(F.struct(F.lit("n/a").alias("severity"), *[
        finding[n].alias(n) for n in ("id", "finding_id", "updatedAt", "type", "description", "service")]))
    flow = record(
        timestamp=F.unix_millis("timestamp"), src_addr=F.lit("10.0.0.1"), dst_addr=F.lit("10.0.0.2"),
        src_port=(k + 1024).cast("string"), dst_port=F.when(k % 5 != 0, F.lit("443")).otherwise(F.lit("-")),
        protocol=F.lit("6"), bytes=F.floor(F.col("value") * 100).cast("string"), packets=k.cast("string"),
        action=F.when(failed, "REJECT").otherwise("ACCEPT"))
    operation = F.concat(F.lit("Microsoft.Compute/"), F.col("event_type"))
    status = F.when(failed, "Failed").otherwise("Succeeded")
    flat_activity = F.to_json(record(
        event_data_id=ident, event_timestamp=time, operation_name=operation, status=status, caller=user,
        level=_pick(AZURE_LEVELS, k % 5), resource_id=F.concat(F.lit("/res/"), k.cast("string")),
        resource_group=F.lit("rg"), category=F.lit("Administrative"), correlation_id=F.lit("c-1")))
    nested_activity = F.to_json(record(
        eventDataId=ident, eventTimestamp=time, operationName=record(value=operation), status=record(value=status),
        caller=user, level=_pick(AZURE_LEVELS, k % 5), resourceId=F.concat(F.lit("/res/"), k.cast("string")),
        resourceGroupName=F.lit("rg"), category=record(value=F.lit("Administrative")), correlationId=F.lit("c-1")))
    security = F.to_json(record(
        alert_id=ident, time_generated=time, display_name=F.concat(F.lit("Alert "), F.col("event_type")),
        alert_type=F.lit("VM_Suspicious"), severity=_pick(ALERT_LEVELS, k % 5), description=F.lit("alert")))
    method = F.when(k % 11 != 0, _pick(METHODS, k % 6))
    nested_gcp = F.to_json(record(
        insertId=ident, timestamp=time, severity=_pick(LOG_LEVELS, k % 9), logName=F.lit("p/logs/cloudaudit.googleapis.com"),
        resource=record(type=F.lit("gce_instance"), labels=record(zone=F.lit("z"))),
        protoPayload=record(methodName=method, resourceName=F.concat(F.lit("projects/"), k.cast("string")),
                            authenticationInfo=record(principalEmail=F.concat(user, F.lit("@example.com"))),
                            requestMetadata=record(callerIp=F.lit("203.0.113.9")))))
    flat_gcp = F.to_json(record(
        raw_entry=record(insertId=ident), timestamp=time, severity=_pick(LOG_LEVELS, k % 9), method_name=method,
        principal_email=F.concat(user, F.lit("@example.com")),
        resource=record(type=F.lit("gce_instance"), labels=record(resourceName=F.concat(F.lit("projects/"), k.cast("string"))))))
    plain = F.to_json(record(raw_entry=record(insertId=ident), timestamp=time, severity=_pick(LOG_LEVELS, k % 9),
                             text_payload=F.col("event_type")))
    source = _pick(RAW_SOURCES, event % 8)
    body = (
        F.when(source == "aws_cloudtrail", F.when(event % 16 == 0, wrapped).otherwise(flat_trail))
        .when(source == "aws_guardduty", F.when(k % 17 == 0, textual).otherwise(F.to_json(finding)))
        .when(source == "aws_vpc_flow_logs", F.to_json(flow))
        .when(source == "azure_activity_logs", F.when(k % 2 == 0, flat_activity).otherwise(nested_activity))
        .when(source == "azure_security_center", security)
        .when(source == "gcp_audit_logs", F.when(k % 2 == 0, nested_gcp).otherwise(flat_gcp))
        .otherwise(plain)
    )
    return rows.select(source.alias("source"), F.concat(source, F.lit(".json")).alias("source_file"),
                       body.alias("body"))


def flow_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(timestamp, message) flow-log lines; every tenth is cut short."""
    rows = base_columns(spark, folder)
    k, text = F.col("k"), lambda c: c.cast("string")
    head = F.concat_ws(
        " ", F.lit("2"), F.lit("acct"), F.concat(F.lit("eni-"), text(F.col("user_id") % 7)),
        F.concat(F.lit("203.0.113."), text(F.col("user_id") % 20)), F.concat(F.lit("10.0.0."), text(k)),
        text(k + 1024), F.lit("443 "), F.lit("6"), text(k + 1), text(F.floor(F.col("value") * 100)),
        text(F.unix_seconds("timestamp")), text(F.unix_seconds("timestamp") + 60))
    tail = F.concat(F.when(F.col("event_type") == "error", " REJECT").otherwise(" ACCEPT"), F.lit("  OK "))
    return rows.select(F.unix_millis("timestamp").alias("timestamp"),
                       F.concat(head, F.when(F.col("event_id") % 10 != 0, tail).otherwise("")).alias("message"))


def geo_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Four addresses per nation, with gaps for every third nation."""
    n = F.col("n_nationkey")
    return read_table(spark, folder, "nation").where(n % 3 != 2).select(
        F.concat(F.lit("203.0.113."), (n * 4).cast("string")).alias("start_ip"),
        F.concat(F.lit("203.0.113."), (n * 4 + 3).cast("string")).alias("end_ip"),
        F.col("n_name").alias("country"), F.concat(F.lit("city-"), n.cast("string")).alias("city"),
        n.cast("double").alias("latitude"), (-n).cast("double").alias("longitude"),
        F.lit("isp").alias("isp"), F.lit("org").alias("organization"))


def nested_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """A range per nation, IPv4 and IPv6: the whole of each family, wide and narrow ones inside, with uneven ends."""
    n = F.col("n_nationkey")
    four = [("0.0.0.0", "255.255.255.255"), ("203.0.0.0", "203.255.255.255"), ("203.0.113.3", "203.0.113.12")]
    six = [("::", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff"), ("2001:db8::", "2001:DB8:0::2f"), ("2001:db8::11", "2001:db8::1c")]
    start, end = F.concat(F.lit("203.0.113."), n.cast("string")), F.concat(F.lit("203.0.113."), (n + 1).cast("string"))
    for at, (first, last) in enumerate([*four, *six]):
        start, end = F.when(n == at, first).otherwise(start), F.when(n == at, last).otherwise(end)
    return read_table(spark, folder, "nation").select(
        start.alias("start_ip"), end.alias("end_ip"), F.col("n_name").alias("country"), F.concat(F.lit("city-"), n.cast("string")).alias("city"),
        n.cast("double").alias("latitude"), (-n).cast("double").alias("longitude"), F.lit("isp").alias("isp"), F.lit("org").alias("organization"))


def assets(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read_table(spark, folder, "nation").where(n % 4 != 3).select(
        F.concat(F.lit("res-"), n.cast("string")).alias("resource_id"), F.col("n_name").alias("owner"),
        F.when(n % 2 == 0, "high").alias("criticality"), F.timestamp_seconds(n * 86400).alias("last_seen"))


def reverse_dns(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read_table(spark, folder, "nation").where(n % 2 == 0).select(
        F.concat(F.lit("203.0.113."), n.cast("string")).alias("ip"),
        F.concat(F.lit("host-"), F.lower("n_name")).alias("hostname"))
