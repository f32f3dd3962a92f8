"""Frequency checks of a stream with Spark's keyed state: one stateful operator and one job a micro-batch.

A key is a check, its subject (a user and an action, an address and an action, a user) and a slice of time one window long.
An event goes to its own slice, which judges it, and to the next one, which only counts it; so a slice knows every event an
event in it can look back to, and however long a subject is busy, a key's state is what two windows hold. When the watermark
passes the end of a slice its timer fires: all its events are judged at once, by the rule of the batch operators, and the state
is cleared. So the order of arrival within the allowed lateness does not matter, verdicts are never revised, and after a
restart the stream goes on from Spark's own checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from palisade.functions.text import slot
from palisade.operators import heuristics as he

#: Check: its window, and the number of earlier events above which an event is reported; as in the batch operators.
CHECKS = {
    "user_count": (he.USER_WINDOW_US, he.USER_FLOOR),
    "ip_count": (he.IP_WINDOW_US, he.IP_FLOOR),
    "failed_count": (he.LOGIN_WINDOW_US, he.LOGIN_MINIMUM - 1),
}
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HELD = T.StructType([
    T.StructField("t", T.LongType()), T.StructField("own", T.BooleanType()), T.StructField("provider", T.StringType()),
    T.StructField("event", T.StringType()), T.StructField("mark", T.LongType())])
SIGNALS = T.StructType([
    T.StructField("check", T.StringType()), T.StructField("sourceProvider", T.StringType()), T.StructField("eventId", T.StringType()),
    T.StructField("t_us", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("prior", T.LongType())])


def subjects(events: DataFrame) -> DataFrame:
    """A row for each check, subject and slice that an event belongs to: check, subject, slice, and what the state holds."""
    rows = he._narrow(events)
    failed = (F.col("eventType") == "authentication") & (F.col("outcome") == "failure")

    def entry(check: str, subject, holds):
        return F.when(holds, F.struct(F.lit(check).alias("check"), subject.alias("subject"), slot(F.col("t_us"), CHECKS[check][0]).alias("slice")))

    def pair(name: str):
        return F.to_json(F.struct(F.col(name), "eventName"), {"ignoreNullFields": "false"})

    entries = F.array_compact(F.array(
        entry("user_count", pair("username"), F.col("username").isNotNull()),
        entry("ip_count", pair("ip"), F.col("ip").isNotNull()),
        entry("failed_count", F.col("username"), F.col("username").isNotNull() & failed)))
    of_event = rows.where("t_us is not null").select(
        "timestamp", F.col("t_us").alias("t"), F.col("sourceProvider").alias("provider"), F.col("eventId").alias("event"), "mark", F.explode(entries).alias("e"))
    return of_event.select("timestamp", "t", "provider", "event", "mark", "e.check", "e.subject", "e.slice", F.explode(F.array(F.lit(True), F.lit(False))).alias("own")).withColumn(
        "slice", F.col("slice") + F.when(F.col("own"), 0).otherwise(1))


def prior(times: np.ndarray, at: np.ndarray, window_us: int) -> np.ndarray:
    """How many ``times`` (ascending) lie in the open interval of a window before each instant."""
    return np.searchsorted(times, at, side="left") - np.searchsorted(times, at - window_us, side="right")


class SliceJudge(StatefulProcessor):
    """Holds the events of a slice and of the one before it until the slice is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        check, _, at = key
        if not self.held.exists():
            self.handle.registerTimer((int(at) + 1) * CHECKS[check][0] // 1000)
        for part in rows:
            own = part["own"].to_numpy(bool)
            # what is only counted needs nothing but its time
            self.held.appendList([
                (int(t), bool(o), p if o else None, e if o else None, int(m) if o else None)
                for t, o, p, e, m in zip(part["t"], own, part["provider"], part["event"], part["mark"])])
        yield pd.DataFrame(columns=SIGNALS.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        check = key[0]
        window_us, floor = CHECKS[check]
        held = list(self.held.get())
        self.held.clear()
        own = [h for h in held if h[1]]
        counts = prior(np.sort(np.array([h[0] for h in held], np.int64)), np.array([h[0] for h in own], np.int64), window_us)
        hits = [(check, h[2], h[3], h[0], h[4], int(n)) for h, n in zip(own, counts) if n > floor]
        yield pd.DataFrame(hits, columns=SIGNALS.names)

    def close(self) -> None:
        pass


def frequency_signals(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """A stream of events to a stream of signals (check, event, prior count), each given once its slice is over."""
    rows = subjects(events.withWatermark("timestamp", lateness))  # events without a subject move the watermark as well
    return rows.groupBy("check", "subject", "slice").transformWithStateInPandas(
        statefulProcessor=SliceJudge(), outputStructType=SIGNALS, outputMode="Append", timeMode="EventTime")


def run_frequency(events: DataFrame, folder: str, checkpoint: str, lateness: str = "10 minutes", available_now: bool = True,
                  poll_seconds: int = 300) -> StreamingQuery:
    """Write the signals to ``folder``. The state lives in RocksDB on the executors and in ``checkpoint``."""
    spark = events.sparkSession
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)  # read when the query starts; other queries keep theirs
    try:
        writer = frequency_signals(events, lateness).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{poll_seconds} seconds")).start()
    finally:
        spark.conf.set(STATE_STORE, before)
