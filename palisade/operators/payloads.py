"""Channel routing and the payload tables a delivery job posts from."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.text import utc_text

log = logging.getLogger(__name__)

# Limits, texts and severity names of the channel payloads.
TEXT_LIMIT, CHAT_INDICATORS, PAGER_INDICATORS = 500, 5, 10
CHAT_DEFAULTS = {"channel": "#security-alerts", "username": "Threat Detector", "mention_on_critical": True}
CHAT_MENTION = "<!channel> Critical security alert!"
FOOTER = "Palisade security alerts"
SUBJECT_PREFIX = "[SECURITY ALERT]"
PAGER_SOURCE, PAGER_DEFAULT = "palisade", "error"
PAGER_SEVERITIES = {"critical": "critical", "high": "error", "medium": "warning", "low": "info"}
PAGER_LEVELS = ["high", "critical"]
MARKDOWN_INDICATORS = 10
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _lines(items: Column, prefix: str, limit: int | None = None) -> Column:
    chosen = F.slice(items, 1, limit) if limit else items
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.lit(prefix), x)), "\n")


def _methods() -> Column:
    return F.array_join("detectionMethods", ", ")


def chat_payload(config: dict | None = None) -> Column:
    config = {**CHAT_DEFAULTS, **(config or {})}
    mention = F.when((F.col("severity") == "critical") & F.lit(config["mention_on_critical"]), CHAT_MENTION).otherwise("")

    def entry(title: str, value: Column, short: bool) -> Column:
        return F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(short).alias("short"))

    fields = F.array(
        entry("Severity", F.upper("severity"), True),
        entry("Alert ID", F.col("alertId"), True),
        entry("Detection Methods", _methods(), True),
        entry("Timestamp", utc_text(F.col("timestamp")), True),
    )
    listed = F.array(entry("Indicators", _lines(F.col("indicators"), "• ", CHAT_INDICATORS), False))
    attachment = F.struct(
        F.col("title").alias("title"),
        F.left("description", F.lit(TEXT_LIMIT)).alias("text"),
        F.when(F.size("indicators") > 0, F.concat(fields, listed)).otherwise(fields).alias("fields"),
        F.lit(FOOTER).alias("footer"),
        F.unix_seconds("timestamp").alias("ts"),
    )
    return F.to_json(F.struct(
        F.lit(config["channel"]).alias("channel"), F.lit(config["username"]).alias("username"),
        mention.alias("text"), F.array(attachment).alias("attachments"),
    ))


def mail_payload(config: dict | None = None) -> Column:
    config = config or {}
    when = utc_text(F.col("timestamp"))
    plain = F.concat_ws(
        "\n", F.lit("\nSecurity Alert\n"),
        F.concat(F.lit("Severity: "), F.upper("severity")),
        F.concat(F.lit("Alert ID: "), F.col("alertId")),
        F.concat(F.lit("Timestamp: "), when), F.lit(""),
        F.col("description"), F.lit(""),
        F.concat(F.lit("Detection Methods: "), _methods()), F.lit(""),
        F.lit("Indicators:"), _lines(F.col("indicators"), "- "), F.lit(""),
        F.lit("---"), F.lit(FOOTER),
    )
    items = F.array_join(F.transform("indicators", lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), "")
    page = F.concat(
        F.lit("<html><body><h2>Security Alert</h2><p><strong>Severity:</strong> "), F.upper("severity"),
        F.lit("</p><p><strong>Alert ID:</strong> "), F.col("alertId"),
        F.lit("</p><p><strong>Timestamp:</strong> "), when,
        F.lit("</p><h3>Description</h3><p>"), F.replace(F.col("description"), F.lit("\n"), F.lit("<br>")),
        F.lit("</p><p><strong>Detection Methods:</strong> "), _methods(),
        F.lit("</p><h3>Indicators</h3><ul>"), items,
        F.lit(f"</ul><hr><p><em>{FOOTER}</em></p></body></html>"),
    )
    return F.to_json(F.struct(
        F.concat(F.lit(config.get("subject_prefix", SUBJECT_PREFIX) + " "), F.col("title")).alias("subject"),
        F.lit(config.get("from_address", "")).alias("from"),
        F.lit(", ".join(config.get("to_addresses", []))).alias("to"),
        plain.alias("text"), page.alias("html"),
    ))


def pager_payload(config: dict | None = None) -> Column:
    config = config or {}
    table = config.get("severity_mapping", PAGER_SEVERITIES)
    level = F.lit(PAGER_DEFAULT)
    for name, mapped_name in table.items():
        level = F.when(F.col("severity") == name, F.lit(mapped_name)).otherwise(level)
    return F.to_json(F.struct(
        F.lit(config.get("integration_key", "")).alias("routing_key"),
        F.lit("trigger").alias("event_action"),
        F.struct(
            F.col("title").alias("summary"), level.alias("severity"), F.lit(PAGER_SOURCE).alias("source"),
            F.struct(
                F.col("alertId").alias("alert_id"), F.col("eventId").alias("eventId"),
                _methods().alias("detection_methods"),
                F.slice("indicators", 1, PAGER_INDICATORS).alias("indicators"),
                F.left("description", F.lit(TEXT_LIMIT)).alias("description"),
            ).alias("custom_details"),
        ).alias("payload"),
        F.col("fingerprint").alias("dedup_key"),
    ))


def hook_payload(config: dict | None = None) -> Column:
    def iso(name: str) -> Column:
        return F.date_format(name, ISO).alias(name)

    return F.to_json(F.struct(
        "alertId", "title", "description", "severity", "eventId", "detectionMethods", "indicators",
        iso("timestamp"), "status", "metadata", "fingerprint", iso("firstSeen"), iso("lastSeen"), "occurrenceCount",
    ))


# Channel name to (which alerts it wants, how its payload looks); a new channel registers here.
CHANNELS = {
    "slack": (lambda: F.lit(True), chat_payload),
    "email": (lambda: F.lit(True), mail_payload),
    "pagerduty": (lambda: F.col("severity").isin(*PAGER_LEVELS), pager_payload),
    "webhook": (lambda: F.lit(True), hook_payload),
}


def register_channel(name: str, wants, payload) -> None:
    CHANNELS[name] = (wants, payload)


def with_occurrences(alerts: DataFrame) -> DataFrame:
    """A fresh alert counts itself once."""
    return (
        alerts.withColumn("occurrenceCount", F.lit(1).cast("bigint"))
        .withColumn("firstSeen", F.col("timestamp")).withColumn("lastSeen", F.col("timestamp"))
    )


def route(alerts: DataFrame, enabled: list[str]) -> DataFrame:
    """One row per (alert, enabled channel that wants it)."""
    wanted = F.array_compact(F.array(*[F.when(CHANNELS[name][0](), F.lit(name)) for name in enabled]))
    return alerts.withColumn("channel", F.explode(wanted))


def payloads(alerts: DataFrame, enabled: dict[str, dict]) -> DataFrame:
    """(alertId, timestamp, channel, payload) for every routed alert."""
    body = F.lit(None).cast("string")
    for name, config in enabled.items():
        body = F.when(F.col("channel") == name, CHANNELS[name][1](config)).otherwise(body)
    return route(alerts, list(enabled)).select("alertId", "timestamp", "channel", body.alias("payload"))


def write_payloads(alerts: DataFrame, enabled: dict[str, dict], folder: str, dry_run: bool = False) -> dict[str, str]:
    """Write each channel's payloads on its own; a failing channel leaves the others alone."""
    failures: dict[str, str] = {}
    if dry_run:
        return failures
    for name, config in enabled.items():
        try:
            payloads(alerts, {name: config}).drop("channel").write.mode("append").parquet(f"{folder}/channel={name}")
        except Exception as error:  # noqa: BLE001 - every channel gets its turn
            log.error("channel %s failed: %s", name, error)
            failures[name] = str(error)
    return failures


def alert_markdown() -> Column:
    def bold(label: str, value: Column, end: str = "\n") -> Column:
        return F.concat(F.lit(f"**{label}:** "), value, F.lit(end))

    size = F.size("indicators")
    more = F.when(size > MARKDOWN_INDICATORS, F.concat(
        F.lit("- ... and "), (size - MARKDOWN_INDICATORS).cast("string"), F.lit(" more\n"))).otherwise("")
    listed = F.when(size > 0, F.concat(
        F.lit("**Indicators:**\n"), _lines(F.col("indicators"), "- ", MARKDOWN_INDICATORS), F.lit("\n"), more, F.lit("\n")
    )).otherwise("")
    seen = F.when(F.col("occurrenceCount") > 1, F.concat(
        bold("Occurrences", F.col("occurrenceCount").cast("string")),
        bold("First Seen", utc_text(F.col("firstSeen"))),
        bold("Last Seen", utc_text(F.col("lastSeen")), "\n\n"),
    )).otherwise("")
    context = [
        F.concat(F.lit(f"- **{key}:** "), F.col(f"metadata.{key}").cast("string"), F.lit("\n"))
        for key in ("sourceProvider", "sourceService", "eventType", "eventName", "overallScore")
    ]
    return F.concat(
        F.lit("## "), F.col("title"), F.lit("\n\n"),
        bold("Severity", F.upper("severity")),
        F.lit("**Alert ID:** `"), F.col("alertId"), F.lit("`\n"),
        F.lit("**Event ID:** `"), F.col("eventId"), F.lit("`\n"),
        bold("Timestamp", utc_text(F.col("timestamp")), "\n\n"),
        F.lit("**Description:**\n"), F.col("description"), F.lit("\n\n"),
        F.when(F.size("detectionMethods") > 0, bold("Detection Methods", _methods(), "\n\n")).otherwise(""),
        listed, seen, F.lit("**Additional Context:**\n"), *context,
    )
