"""Raw provider records (``source``, ``body`` as JSON text) to unified events.

Every provider is a mapping from event field to expression over one typed view of the body. The
raw table is scanned once: each row's body is read into the view of its own source and only that
source's mapping is evaluated. Both record shapes are accepted: flat records as the collectors write them
and the provider's own nested JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.classify import (
    AZURE_ACTIVITY_LEVELS, AZURE_ALERT_SEVERITIES, GCP_SEVERITIES, classify_aws, classify_gcp,
    finding_severity, mapped,
)
from palisade.functions.text import first_nonempty
from palisade.schema import ACTOR, EVENT, NETWORK, RESOURCE, typed_struct

# Target field to path in the provider's own JSON.
CLOUDTRAIL_FIELDS = {
    "eventId": "eventID",
    "eventName": "eventName",
    "eventTime": "eventTime",
    "username": "userIdentity.userName",
    "user_type": "userIdentity.type",
    "source_ip": "sourceIPAddress",
    "user_agent": "userAgent",
    "aws_region": "awsRegion",
    "error_code": "errorCode",
    "error_message": "errorMessage",
}
AZURE_ACTIVITY_FIELDS = {
    "eventId": "operationId",
    "eventName": "operationName.value",
    "eventTime": "eventTimestamp",
    "caller": "caller",
    "level": "level",
    "status": "status.value",
    "resource_id": "resourceId",
    "subscriptionId": "subscriptionId",
}
GCP_AUDIT_FIELDS = {
    "method_name": "protoPayload.methodName",
    "service_name": "protoPayload.serviceName",
    "principal_email": "protoPayload.authenticationInfo.principalEmail",
    "caller_ip": "protoPayload.requestMetadata.callerIp",
    "status_code": "protoPayload.status.code",
    "resource_name": "protoPayload.resourceName",
}
FIELD_MAPPINGS = {
    "aws_cloudtrail": CLOUDTRAIL_FIELDS,
    "azure_activity_logs": AZURE_ACTIVITY_FIELDS,
    "gcp_audit_logs": GCP_AUDIT_FIELDS,
}

BODY = "body"


def at(path: str, kind: str = "string", body: str = BODY) -> Column:
    """Value at a dotted path of the body text; null on any miss or type clash."""
    steps = "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.split("."))
    if kind == "string":
        return F.get_json_object(body, "$" + steps)
    return F.try_variant_get(F.try_parse_json(body), "$" + steps, kind)


def text_at(*paths: str) -> Column:
    """First of several paths that holds a value. List nested paths before the flat key they share
    a name with: a path into plain text is a miss, while an object would be taken as its JSON."""
    return F.coalesce(*[at(path) for path in paths])


def map_fields(df: DataFrame, mapping: dict[str, str], body: str = BODY) -> DataFrame:
    """Project the mapped paths of the body; paths that miss are null."""
    return df.select(*[at(path, body=body).alias(target) for target, path in mapping.items()])


def event_time(*paths: str) -> Column:
    return F.coalesce(*[text_at(p).try_cast("timestamp") for p in paths])


# What each source's projection reads from a body, as one typed view (both record shapes).
_TRAIL = (
    "eventID string, eventTime string, eventName string, eventCategory string, sourceIPAddress string, "
    "userAgent string, recipientAccountId string, errorCode string, errorMessage string, "
    "requestParameters variant, responseElements variant, userIdentity struct<userName:string, "
    "principalId:string, type:string, sessionContext:struct<sessionIssuer:struct<userName:string>>>"
)
VIEWS = {
    "aws_cloudtrail": f"{_TRAIL}, username string, resources array<struct<ARN:string, ResourceType:string, "
                      f"ResourceName:string>>, cloud_trail_event struct<{_TRAIL}>",
    "aws_guardduty": "id string, finding_id string, updatedAt string, createdAt string, type string, description string, "
                     "severity variant, service struct<eventLastSeen:string, action:struct<actionType:string, "
                     "networkConnectionAction:struct<remoteIpDetails:struct<ipAddressV4:string>, "
                     "localIpDetails:struct<ipAddressV4:string>, localPortDetails:struct<port:int>, protocol:string>>>",
    "aws_vpc_flow_logs": "timestamp bigint, src_addr string, dst_addr string, src_port string, dst_port string, "
                         "protocol string, bytes string, packets string, action string",
    "azure_activity_logs": "event_data_id string, eventDataId string, operationId string, event_timestamp string, "
                           "eventTimestamp string, operation_name string, operationName struct<value:string>, "
                           "category variant, status variant, level string, caller string, resourceId string, "
                           "resource_id string, resource_group string, resourceGroupName string, description string, "
                           "correlation_id string, correlationId string",
    "azure_security_center": "alertId string, alert_id string, time_generated string, display_name string, "
                             "severity string, description string, alert_type string",
    "gcp_audit_logs": "raw_entry struct<insertId:string>, insertId string, timestamp string, severity string, "
                      "method_name string, principal_email string, request variant, response variant, "
                      "resource struct<type:string, labels:struct<resourceName:string>>, "
                      "protoPayload struct<methodName:string, resourceName:string, request:variant, response:variant, "
                      "authenticationInfo:struct<principalEmail:string>, requestMetadata:struct<callerIp:string>>",
}
VIEWS["gcp_cloud_logging"] = VIEWS["gcp_audit_logs"]


def view_name(source: str) -> str:
    return f"__view_{source}"


def _fields(source: str):
    """(field, time): accessors into the typed view of one source, first value of several paths."""
    view = view_name(source)

    def field(*paths: str) -> Column:
        return F.coalesce(*[F.col(f"{view}.{p}") for p in paths]) if len(paths) > 1 else F.col(f"{view}.{paths[0]}")

    def time(*paths: str) -> Column:
        return F.coalesce(*[field(p).try_cast("timestamp") for p in paths])

    return field, time


def cloudtrail() -> dict[str, Column]:
    field, time = _fields("aws_cloudtrail")

    def trail(path: str) -> Column:  # the wrapped event when there is one, else the record itself
        return field(f"cloud_trail_event.{path}", path)

    name = F.coalesce(trail("eventName"), F.lit(""))
    wrapped = field("cloud_trail_event").isNotNull()
    first = F.get(field("resources"), F.lit(0))
    return {
        "eventId": F.coalesce(trail("eventID"), at("eventId"), F.lit("")),
        "timestamp": time("cloud_trail_event.eventTime", "eventTime"),
        "sourceProvider": F.lit("aws"),
        "sourceService": F.lit("cloudtrail"),
        "eventType": classify_aws(name),
        "eventName": name,
        "eventCategory": trail("eventCategory"),
        "severity": F.lit("info"),
        "actor": typed_struct({
            "username": first_nonempty(trail("userIdentity.userName"), field("username")),
            "userId": trail("userIdentity.principalId"),
            "userType": trail("userIdentity.type"),
            "ipAddress": trail("sourceIPAddress"),
            "userAgent": trail("userAgent"),
            "sessionId": trail("userIdentity.sessionContext.sessionIssuer.userName"),
        }, ACTOR),
        "resource": F.when(first.isNotNull(), typed_struct({
            "resourceId": first["ARN"],
            "resourceType": first["ResourceType"],
            "resourceName": first["ResourceName"],
            "accountId": trail("recipientAccountId"),
        }, RESOURCE)),
        "action": name,
        "outcome": F.when(F.nullif(trail("errorCode"), F.lit("")).isNotNull(), "failure").otherwise("success"),
        "outcome_reason": trail("errorMessage"),
        "requestParameters": F.when(wrapped, field("cloud_trail_event.requestParameters"))
        .otherwise(field("requestParameters")),
        "responseElements": F.when(wrapped, field("cloud_trail_event.responseElements"))
        .otherwise(field("responseElements")),
    }


def guardduty() -> dict[str, Column]:
    field, time = _fields("aws_guardduty")
    severity = field("severity")
    numeric = F.schema_of_variant(severity) != "STRING"
    value = F.when(severity.isNull(), F.lit(0.0)).when(numeric, F.try_variant_get(severity, "$", "double"))
    kind = F.coalesce(field("type"), F.lit(""))
    connection = "service.action.networkConnectionAction"
    network = typed_struct({
        "sourceIp": field(f"{connection}.remoteIpDetails.ipAddressV4"),
        "destinationIp": field(f"{connection}.localIpDetails.ipAddressV4"),
        "destinationPort": field(f"{connection}.localPortDetails.port"),
        "protocol": field(f"{connection}.protocol"),
    }, NETWORK)
    return {
        "eventId": F.coalesce(field("finding_id"), field("id"), F.lit("")),
        "timestamp": time("updatedAt", "service.eventLastSeen", "createdAt"),
        "sourceProvider": F.lit("aws"),
        "sourceService": F.lit("guardduty"),
        "eventType": F.lit("security_alert"),
        "eventName": kind,
        "severity": finding_severity(value),
        "network": F.when(field("service.action.actionType") == "NETWORK_CONNECTION", network),
        "outcome": F.lit("unknown"),
        "description": field("description"),
        "threatIndicators": F.array(kind),
        "risk_score": value / F.lit(10.0),
    }


def vpc_flow() -> dict[str, Column]:
    field, _ = _fields("aws_vpc_flow_logs")
    millis = field("timestamp")
    return {
        "eventId": F.concat(F.lit("vpc_flow_"), millis.cast("string")),
        "timestamp": F.timestamp_millis(millis),
        "sourceProvider": F.lit("aws"),
        "sourceService": F.lit("vpc_flow_logs"),
        "eventType": F.lit("network_traffic"),
        "eventName": F.lit("network_connection"),
        "severity": F.lit("info"),
        "network": typed_struct({
            "sourceIp": field("src_addr"),
            "source_port": field("src_port").try_cast("int"),
            "destinationIp": field("dst_addr"),
            "destinationPort": field("dst_port").try_cast("int"),
            "protocol": field("protocol"),
            "bytesSent": field("bytes").try_cast("bigint"),
            "packets": field("packets").try_cast("bigint"),
            "action": field("action"),
        }, NETWORK),
        "outcome": F.lit("unknown"),
    }


def _plain_or_value(value: Column) -> Column:
    """Text that comes as is or as the ``value`` of an object."""
    return F.coalesce(F.try_variant_get(value, "$.value", "string"), F.try_variant_get(value, "$", "string"))


def azure_activity() -> dict[str, Column]:
    field, time = _fields("azure_activity_logs")
    caller = field("caller")
    name = field("operation_name", "operationName.value")
    return {
        "eventId": F.coalesce(field("event_data_id"), field("eventDataId"), field("operationId"), F.lit("")),
        "timestamp": time("event_timestamp", "eventTimestamp"),
        "sourceProvider": F.lit("azure"),
        "sourceService": F.lit("activityLogs"),
        "eventType": F.lit("administrative_action"),
        "eventName": F.coalesce(name, F.lit("")),
        "eventCategory": _plain_or_value(field("category")),
        "severity": mapped(field("level"), AZURE_ACTIVITY_LEVELS, "info"),
        "actor": typed_struct({"email": caller, "userId": caller}, ACTOR),
        "resource": typed_struct({
            "resourceId": field("resourceId", "resource_id"),
            "resourceName": field("resource_group", "resourceGroupName"),
            "resourceType": F.lit("azure_resource"),
        }, RESOURCE),
        "action": name,
        "outcome": F.when(_plain_or_value(field("status")) == "Succeeded", "success").otherwise("failure"),
        "description": field("description"),
        "correlation_id": field("correlation_id", "correlationId"),
    }


def azure_security() -> dict[str, Column]:
    field, time = _fields("azure_security_center")
    return {
        "eventId": F.coalesce(field("alertId"), field("alert_id"), F.lit("")),
        "timestamp": time("time_generated"),
        "sourceProvider": F.lit("azure"),
        "sourceService": F.lit("security_center"),
        "eventType": F.lit("security_alert"),
        "eventName": F.coalesce(field("display_name"), F.lit("")),
        "severity": mapped(field("severity"), AZURE_ALERT_SEVERITIES, "medium"),
        "outcome": F.lit("unknown"),
        "description": field("description"),
        "threatIndicators": F.array(F.coalesce(field("alert_type"), F.lit(""))),
    }


def gcp_log(source: str = "gcp_audit_logs") -> dict[str, Column]:
    field, time = _fields(source)
    email = field("principal_email", "protoPayload.authenticationInfo.principalEmail")
    method = field("method_name", "protoPayload.methodName")
    return {
        "eventId": F.coalesce(field("raw_entry.insertId"), field("insertId"), F.lit("")),
        "timestamp": time("timestamp"),
        "sourceProvider": F.lit("gcp"),
        "sourceService": F.col("source"),
        "eventType": classify_gcp(method),
        "eventName": F.coalesce(method, F.lit("")),
        "severity": mapped(F.coalesce(field("severity"), F.lit("INFO")), GCP_SEVERITIES, "info"),
        "actor": typed_struct({
            "email": email, "userId": email, "ipAddress": field("protoPayload.requestMetadata.callerIp"),
        }, ACTOR),
        "resource": typed_struct({
            "resourceType": field("resource.type"),
            "resourceName": field("resource.labels.resourceName", "protoPayload.resourceName"),
        }, RESOURCE),
        "action": method,
        "outcome": F.lit("unknown"),
        "requestParameters": field("request", "protoPayload.request"),
        "responseElements": field("response", "protoPayload.response"),
    }


def gcp_logging() -> dict[str, Column]:
    return gcp_log("gcp_cloud_logging")


# The projection of every known source; a new feed registers its view and projection here.
PROJECTIONS = {
    "aws_cloudtrail": cloudtrail,
    "aws_guardduty": guardduty,
    "aws_vpc_flow_logs": vpc_flow,
    "azure_activity_logs": azure_activity,
    "azure_security_center": azure_security,
    "gcp_audit_logs": gcp_log,
    "gcp_cloud_logging": gcp_logging,
}


def register_projection(source: str, view: str, projection) -> None:
    VIEWS[source] = view
    PROJECTIONS[source] = projection
    _built.clear()


def known_source() -> Column:
    return F.coalesce(F.col("source").isin(*PROJECTIONS), F.lit(False))


_built: dict[str, tuple[dict[str, Column], list[Column]]] = {}


def _projection(application: str) -> tuple[dict[str, Column], list[Column]]:
    """Parsed views and event columns of all registered sources; built once per session, since every
    micro-batch uses the same."""
    if application not in _built:
        views = {
            view_name(source): F.when(F.col("source") == source, F.from_json(BODY, T.StructType.fromDDL(view)))
            for source, view in VIEWS.items()
        }
        mappings = {source: projection() for source, projection in PROJECTIONS.items()}
        columns = []
        for field in EVENT.fields:
            if field.name == "rawEvent":
                value = F.try_parse_json(BODY)
            elif field.name in ("ingestion_timestamp", "normalization_timestamp"):
                value = F.current_timestamp()
            else:
                value = F.lit(None).cast(field.dataType)
                for source, mapping in mappings.items():
                    if field.name in mapping:
                        value = F.when(F.col("source") == source, mapping[field.name].cast(field.dataType)).otherwise(value)
                if field.name == "threatIndicators":
                    value = F.coalesce(value, F.array().cast(T.ArrayType(T.StringType())))
            columns.append(value.alias(field.name))
        _built[application] = views, columns
    return _built[application]


def normalize(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Unified events of every known source; other records are left to ``unknown_records``."""
    views, columns = _projection(raw.sparkSession.sparkContext.applicationId)
    return raw.where(known_source()).withColumns(views).select(*columns, *(keep or []))


def unknown_records(raw: DataFrame) -> DataFrame:
    return raw.where(~known_source())


def is_valid() -> Column:
    """An event needs an id, a parsed time, a provider and a name."""
    checks = F.col("timestamp").isNotNull()
    for name in ("eventId", "sourceProvider", "eventName"):
        checks = checks & (F.coalesce(F.col(name), F.lit("")) != "")
    return checks


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    return events.where(is_valid()), events.where(~is_valid())


TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
RECORD = T.StructType([
    T.StructField(f.name, T.StringType() if isinstance(f.dataType, (T.TimestampType, T.VariantType)) else f.dataType)
    for f in EVENT.fields
    if f.name != "enrichment"
])


def to_record(events: DataFrame) -> DataFrame:
    """Each event as one JSON record with ISO times."""
    fields = []
    for f in RECORD.fields:
        source = EVENT[f.name].dataType
        if isinstance(source, T.TimestampType):
            fields.append(F.date_format(f.name, TIME_FORMAT).alias(f.name))
        elif isinstance(source, T.VariantType):
            fields.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            fields.append(F.col(f.name))
    return events.select(F.to_json(F.struct(*fields)).alias("record"))


def from_record(records: DataFrame) -> DataFrame:
    parsed = records.select(F.from_json("record", RECORD).alias("r"))
    columns = []
    for f in EVENT.fields:
        if f.name == "enrichment":
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.TimestampType):
            columns.append(F.try_to_timestamp(F.col(f"r.{f.name}"), F.lit(TIME_FORMAT)).alias(f.name))
        elif isinstance(f.dataType, T.VariantType):
            columns.append(F.try_parse_json(F.col(f"r.{f.name}")).alias(f.name))
        else:
            columns.append(F.col(f"r.{f.name}").alias(f.name))
    return parsed.select(*columns)
