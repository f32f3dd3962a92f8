"""Event-name classifiers and severity vocabularies of the providers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name fragments per event type; the first type with a hit wins.
AWS_NAME_FRAGMENTS = [
    ("authentication", ["login", "authenticate"]),
    ("authorization", ["authorize", "policy"]),
    ("configuration_change", ["create", "delete", "update"]),
    ("resource_access", ["get", "list", "describe"]),
]
GCP_NAME_FRAGMENTS = [
    ("authentication", ["login", "authenticate"]),
    ("configuration_change", ["create", "delete", "update"]),
    ("resource_access", ["get", "list"]),
]

# Provider severity names to ours.
AZURE_ACTIVITY_LEVELS = {"Critical": "critical", "Error": "high", "Warning": "medium", "Informational": "info"}
AZURE_ALERT_SEVERITIES = {"High": "high", "Medium": "medium", "Low": "low", "Informational": "info"}
GCP_SEVERITIES = {"CRITICAL": "critical", "ERROR": "high", "WARNING": "medium", "INFO": "info", "DEBUG": "info"}
# Finding severity as a whole number, lower bound of each band (0 to 10).
FINDING_BANDS = [(0, "info"), (1, "low"), (4, "medium"), (7, "high"), (9, "critical")]
FINDING_MAX = 10

# Log severities of the general logging feed, lowest first.
GCP_LOG_LEVELS = ["DEFAULT", "DEBUG", "INFO", "NOTICE", "WARNING", "ERROR", "CRITICAL", "ALERT", "EMERGENCY"]


def _by_fragments(name: Column, table: list[tuple[str, list[str]]]) -> Column:
    lowered = F.lower(F.coalesce(name, F.lit("")))
    kind = F.lit("unknown")
    for event_type, fragments in reversed(table):
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | lowered.contains(fragment)
        kind = F.when(hit, F.lit(event_type)).otherwise(kind)
    return kind


def classify_aws(name: Column) -> Column:
    return _by_fragments(name, AWS_NAME_FRAGMENTS)


def classify_gcp(name: Column) -> Column:
    return _by_fragments(name, GCP_NAME_FRAGMENTS)


def mapped(value: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.coalesce(value, F.lit(""))), F.lit(default))


def finding_severity(value: Column) -> Column:
    """Band of the truncated number; medium when it is missing a band or no number at all."""
    whole = F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value))
    band = F.lit("medium")
    for lower, name in FINDING_BANDS:
        band = F.when(whole >= lower, F.lit(name)).otherwise(band)
    inside = (whole >= 0) & (whole <= FINDING_MAX)
    return F.when(F.coalesce(inside, F.lit(False)), band).otherwise(F.lit("medium"))


def log_level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in GCP_LOG_LEVELS]), F.upper(level))
