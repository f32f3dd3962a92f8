"""The whole run: normalise, enrich, detect, alert, de-duplicate, throttle."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.operators.alerts import build_alerts
from palisade.operators.anomaly import Model, with_anomaly
from palisade.operators.dedup import deduplicate
from palisade.operators.enrich import enrich
from palisade.operators.fusion import fuse
from palisade.operators.heuristics import history_signals, with_heuristics, without_heuristics
from palisade.operators.normalize import is_valid, normalize, unknown_records
from palisade.operators.payloads import with_occurrences, write_payloads
from palisade.operators.rules import Rule, with_matched_rules
from palisade.operators.throttle import LIMIT, outcomes
from palisade.session import land
from palisade.sources.store import EVENT_DAYS, merge_events, read_store


def detect(events: DataFrame, rules: list[Rule], model: Model | None = None, history: bool = True,
           heuristics: bool = True) -> DataFrame:
    """Events with ``matchedRules``, ``anomaly``, ``heuristic`` and the fused verdict.

    An engine is switched off by no rules, no model, or ``heuristics=False``."""
    judged = with_anomaly(with_matched_rules(events, rules), model)
    if not heuristics:
        return fuse(without_heuristics(judged))
    return fuse(with_heuristics(judged, history_signals(events) if history else None))


def within(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Rows with a time in [start, end); an end that is not given is open."""
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    return df if end is None else df.where(F.col("timestamp") < F.lit(end).cast("timestamp"))


def events_from_raw(raw: DataFrame, dimensions: dict[str, DataFrame] | None = None) -> DataFrame:
    events = normalize(raw).where(is_valid())
    return enrich(events, dimensions) if dimensions else events


def finish(alerts: DataFrame, deduplicating: bool = True, throttling: bool = True, limit: int = LIMIT) -> DataFrame:
    """Alerts with ``anchor``, ``duplicate`` and ``outcome``; either step can be switched off."""
    if deduplicating:
        placed = land(deduplicate(alerts))
    else:
        placed = alerts.withColumn("anchor", F.col("timestamp")).withColumn("duplicate", F.lit(False))
    if throttling:
        return outcomes(placed, limit)
    return placed.withColumn("outcome", F.when(F.col("duplicate"), "deduplicated").otherwise("dispatched")).drop("rowId")


def run(events: DataFrame, rules: list[Rule], model: Model | None = None, start: str | None = None, end: str | None = None,
        heuristics: bool = True, deduplicating: bool = True, throttling: bool = True, limit: int = LIMIT) -> DataFrame:
    """All alerts of events in [start, end) with their window and end state; earlier events count as history.

    Alerts and their windows are each written once (in the shared checkpoint folder): the
    following steps read them several times and must not repeat the detection."""
    judged = within(detect(events, rules, model, heuristics=heuristics), start, end)
    return finish(build_alerts(judged), deduplicating, throttling, limit)


def run_store(spark: SparkSession, store: str, rules: list[Rule], start: str, end: str, model: Model | None = None,
              lookback_days: int = EVENT_DAYS, **switches) -> DataFrame:
    """Alerts of [start, end) from a stored table; of the history, ``lookback_days`` are read."""
    first = (datetime.fromisoformat(start) - timedelta(days=lookback_days)).date().isoformat()
    last = (datetime.fromisoformat(end) + timedelta(days=1)).date().isoformat()
    events = within(read_store(spark, store, first, last).drop("date"), None, end)
    return run(events, rules, model, start, end, **switches)


def run_raw(raw: DataFrame, rules: list[Rule], store: str, dimensions: dict[str, DataFrame] | None = None,
            model: Model | None = None, **switches) -> DataFrame:
    """From raw records: add the typed events to the store first, because detection scans them column-wise
    once per history check and the JSON should be parsed only once. Events of earlier runs stay. Records
    without a projection and events that fail validation are kept beside the store, in ``<store>-unknown`` and
    ``<store>-rejected``."""
    unknown_records(raw).write.mode("append").parquet(f"{store}-unknown")
    normalize(raw).where(~is_valid()).write.mode("append").parquet(f"{store}-rejected")
    merge_events(events_from_raw(raw, dimensions), store)
    return run(raw.sparkSession.read.parquet(store).drop("date"), rules, model, **switches)


def dispatch(done: DataFrame, channels: dict[str, dict], folder: str, dry_run: bool = False) -> dict[str, str]:
    """Write the payloads of dispatched alerts, and of no others, per channel; returns what failed."""
    return write_payloads(with_occurrences(done.where(F.col("outcome") == "dispatched")), channels, folder, dry_run)
