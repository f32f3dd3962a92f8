"""Counters of a running stream, taken from rows on their way: nothing is scanned a second time.

``observe_raw`` and ``observe_events`` put observations into the streaming plan, whose values arrive with each progress
report; ``MetricsListener`` writes them, with the report's rows and times, as one small table a micro-batch. The
continuous job counts late events and alerts by end state with observations on tables that it writes anyway
(``ContinuousDetection(counting=True)``).

A replayed micro-batch overwrites its own counts, so a restart counts nothing twice. Counts are exact unless
an executor is lost during a batch: Spark may then add up what a repeated task saw again.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from palisade.operators.normalize import is_valid, known_source

log = logging.getLogger(__name__)

COUNTS = "stage string, n long"
TIMES = "events long, took_ms long"


def _counts(stages: dict[str, Column]) -> list[Column]:
    return [F.count_if(c).alias(s) for s, c in stages.items()]


def observe_raw(raw: DataFrame) -> DataFrame:
    """Records as they arrive, and those that no projection knows."""
    return raw.observe("raw", *_counts({"events_ingested": F.lit(True), "errors_normalization": ~known_source()}))


def observe_events(events: DataFrame) -> DataFrame:
    """Normalised events before invalid ones are split off."""
    return events.observe("events", *_counts({
        "events_normalized": F.lit(True), "events_processed": is_valid(), "errors_validation": ~is_valid()}))


class Counter:
    """Counts rows of a table while it is written: ``watch`` it, write it, then ``rows``."""

    def __init__(self, **stages: Column):
        self.stages, self.observation = stages, Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        return df.observe(self.observation, *_counts(self.stages))

    def rows(self) -> list[tuple[str, int]]:
        """Waits for the write; so call it after one."""
        found = self.observation.get
        return [(stage, int(found[stage] or 0)) for stage in self.stages]


def late_counter() -> Counter:
    return Counter(events_judged=F.col("__fits"), events_late=~F.col("__fits"))


def alert_counter() -> Counter:
    ends = {f"alerts_{end}": F.col("outcome") == end for end in ("dispatched", "deduplicated", "throttled")}
    return Counter(alerts_generated=F.lit(True), **ends)


def write_counts(spark: SparkSession, rows: list[tuple[str, int]], folder: str) -> None:
    spark.createDataFrame(rows, COUNTS).coalesce(1).write.mode("overwrite").parquet(folder)


class MetricsListener(StreamingQueryListener):
    """Writes every micro-batch's observed counts to ``folder/counts`` and its rows and time to ``folder/times``, by query
    and batch. Only queries named in ``names`` are written, if any are. A failing write is logged and stops no stream."""

    def __init__(self, spark: SparkSession, folder: str, names: set[str] | None = None):
        self.spark, self.folder, self.names = spark, folder, names

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        report = json.loads(event.progress.json)
        observed = {s: n for row in report.get("observedMetrics", {}).values() for s, n in row.items()}
        if (self.names and report.get("name") not in self.names) or (not observed and not report["numInputRows"]):
            return
        place = f"query={report['id']}/batch={report['batchId']}"
        took = report["durationMs"].get("triggerExecution", 0)
        try:
            # counts come last: whoever sees a batch's counts finds its rows and time too
            self.spark.createDataFrame([(report["numInputRows"], took)], TIMES).coalesce(1).write.mode("overwrite").parquet(
                f"{self.folder}/times/{place}")
            write_counts(self.spark, [(s, int(n or 0)) for s, n in sorted(observed.items())], f"{self.folder}/counts/{place}")
        except Exception as error:  # noqa: BLE001 - metrics must not end the stream they describe
            log.error("metrics of %s not written: %s", place, error)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_counts(spark: SparkSession, *folders: str) -> DataFrame:
    """(stage, n) over all micro-batches of the given tables of counts, as ``metrics.stage_counts`` gives them for a batch."""
    rows = None
    for folder in folders:
        part = spark.read.schema(COUNTS).option("recursiveFileLookup", True).parquet(folder)
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("stage").agg(F.sum("n").alias("n"))


def stream_latency(spark: SparkSession, folder: str) -> DataFrame:
    """Events, milliseconds an event (all, best, worst batch) and events a second from the stored times; 0 when idle."""
    times = spark.read.schema(TIMES).option("recursiveFileLookup", True).parquet(f"{folder}/times").where("events > 0")
    rows, took, each = F.sum("events"), F.sum("took_ms"), F.col("took_ms") / F.col("events")
    zero = F.lit(0.0)
    return times.agg(
        F.coalesce(rows, F.lit(0)).alias("events"), F.coalesce(F.try_divide(took, rows), zero).alias("avg_ms"),
        F.coalesce(F.min(each), zero).alias("min_ms"), F.coalesce(F.max(each), zero).alias("max_ms"),
        F.coalesce(F.try_divide(rows * 1000.0, took), zero).alias("events_per_second"))
