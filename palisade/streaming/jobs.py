"""Continuous detection with Structured Streaming.

Each micro-batch goes through the batch operators together with the state tables of the earlier
ones: the last minutes of events for trailing counts, first-seen pairs for baselines, open
windows for de-duplication and recently passed alerts for the rate limit.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.operators import heuristics as he
from palisade.operators.alerts import build_alerts
from palisade.operators.anomaly import Model, with_anomaly
from palisade.operators.dedup import WINDOW_US, deduplicate
from palisade.operators.fusion import fuse
from palisade.operators.metrics import sliding_counts
from palisade.operators.registry import ModelRegistry
from palisade.operators.rules import PACK, load_rules, with_matched_rules
from palisade.operators.throttle import HOUR_US, LIMIT, throttle
from palisade.schema import EVENT_KEY
from palisade.session import land, number_rows
from palisade.streaming.observed import Counter, alert_counter, late_counter, write_counts
from palisade.streaming.state import StateTables

log = logging.getLogger(__name__)

# Polling interval and how late an event may be.
POLL_SECONDS = 300
ALLOWED_LATENESS_US = 10 * 60_000_000
HISTORY_US = 2 * he.LOGIN_WINDOW_US
HISTORY_COLUMNS = [*EVENT_KEY, "eventName", "eventType", "outcome", "actor", "resource"]

BASELINES = {
    "countries": (he.country_pairs, he.new_locations, "user", "country"),
    "actions": (he.action_pairs, he.unusual_actions, "user", "eventName"),
    "accessors": (he.accessor_pairs, he.unusual_accessors, "resourceId", "username"),
}


def _after(horizon: DataFrame, rows: DataFrame, column: str, back_us: int) -> DataFrame:
    """Rows no older than ``back_us`` before the latest event time (a one-row table)."""
    latest = horizon.first()["latest"]
    return rows if latest is None else rows.where(F.unix_micros(column) > latest - back_us)


class ContinuousDetection:
    """``foreachBatch`` handler; rules are re-read from their folder with every micro-batch, and so is the current model
    if a registry is given. With ``counting``, each batch's counts go to ``folder/counts`` (``observed.stream_counts``)."""

    def __init__(self, folder: str, rules: str = PACK, model: Model | ModelRegistry | None = None, limit: int = LIMIT,
                 dedup_us: int = WINDOW_US, throttle_us: int = HOUR_US, dry_run: bool = False,
                 clock: Callable[[], float] = time.time, counting: bool = False):
        self.folder, self.rules, self.model = folder, rules, model
        self.limit, self.dedup_us, self.throttle_us, self.dry_run = limit, dedup_us, throttle_us, dry_run
        self.clock, self.counting = clock, counting

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        state = StateTables(batch.sparkSession, f"{self.folder}/state")
        arrivals, ends = late_counter(), alert_counter()
        events = self._on_time(batch, state, epoch, arrivals)
        signals = he.combine_signals([*self._frequencies(events, state, epoch), *self._baselines(events, state, epoch)])
        model = self.model
        if isinstance(model, ModelRegistry):
            model = model.for_batch(batch.sparkSession, f"{self.folder}/models", epoch)
        judged = with_anomaly(with_matched_rules(events, load_rules(self.rules)), model)
        alerts = number_rows(build_alerts(fuse(he.with_heuristics(judged, land(signals)))))
        done = self._end_states(alerts, state, epoch, ends)
        state.replace("horizon", epoch, self._horizon(events, state, epoch))
        if not self.dry_run:
            done.write.mode("overwrite").parquet(f"{self.folder}/alerts/epoch={epoch}")
        if self.counting:
            write_counts(batch.sparkSession, arrivals.rows() + ends.rows(), f"{self.folder}/counts/epoch={epoch}")

    def _horizon(self, events: DataFrame, state: StateTables, epoch: int) -> DataFrame:
        latest = events.select(F.unix_micros("timestamp").alias("latest"))
        earlier = state.latest("horizon", epoch)
        rows = latest if earlier is None else latest.unionByName(earlier)
        return rows.agg(F.max("latest").alias("latest")).coalesce(1)

    def _watched(self, df: DataFrame, counter: Counter) -> DataFrame:
        return counter.watch(df) if self.counting else df

    def _on_time(self, events: DataFrame, state: StateTables, epoch: int, arrivals: Counter) -> DataFrame:
        """Events without a time, older than the allowed lateness, or further ahead of the clock than that go to a side
        table instead of being judged; so neither is lost, and no future time moves the horizon."""
        horizon = state.latest("horizon", epoch)
        latest = None if horizon is None else horizon.first()["latest"]
        us = F.unix_micros("timestamp")
        fits = us <= int(self.clock() * 1_000_000) + ALLOWED_LATENESS_US
        if latest is not None:
            fits = fits & (us > latest - ALLOWED_LATENESS_US)
        marked = land(self._watched(events.withColumn("__fits", F.coalesce(fits, F.lit(False))), arrivals))
        marked.where("not __fits").drop("__fits").write.mode("overwrite").parquet(f"{self.folder}/late/epoch={epoch}")
        return marked.where("__fits").drop("__fits")

    def _frequencies(self, events: DataFrame, state: StateTables, epoch: int) -> list[DataFrame]:
        fresh = events.select(*HISTORY_COLUMNS)
        earlier = state.latest("recent", epoch)
        history = land(fresh if earlier is None else earlier.unionByName(fresh))
        keys = fresh.select(*EVENT_KEY)
        checks = [he.user_frequency, he.ip_frequency, he.failed_logins]
        hits = [check(history).join(keys, EVENT_KEY, "left_semi") for check in checks]
        horizon = self._horizon(events, state, epoch)
        state.replace("recent", epoch, _after(horizon, history, "timestamp", HISTORY_US))
        return hits

    def _baselines(self, events: DataFrame, state: StateTables, epoch: int) -> list[DataFrame]:
        hits = []
        keys = events.select(*EVENT_KEY)
        for name, (pairs_of, check, owner, item) in BASELINES.items():
            fresh = land(pairs_of(events))
            stored = state.grown(name, epoch)
            if stored is None:
                hits.append(check(events))
                state.add(name, epoch, fresh)
                continue
            owners = fresh.select(owner).distinct()
            if owner == "user":  # readers without a user name look their user id up as well
                owners = events.select(he.user_key().alias("user")).where("user is not null").distinct()
            known = land(stored.join(owners, owner, "left_semi"))
            hits.append(check(events, baseline=known).join(keys, EVENT_KEY, "left_semi"))
            state.add(name, epoch, fresh.join(known, [owner, item], "left_anti"))
        return hits

    def _end_states(self, alerts: DataFrame, state: StateTables, epoch: int, ends: Counter) -> DataFrame:
        placed = land(deduplicate(alerts, self.dedup_us, open_anchors=state.latest("anchors", epoch)))
        earlier = state.latest("passed", epoch)
        survivors = land(throttle(placed.where(~F.col("duplicate")), self.limit, self.throttle_us, earlier=earlier))
        duplicates = placed.where("duplicate").withColumn("outcome", F.lit("deduplicated"))
        named = survivors.withColumn("outcome", F.when(F.col("throttled"), "throttled").otherwise("dispatched"))
        done = land(self._watched(named.drop("throttled").unionByName(duplicates).drop("rowId"), ends))

        anchors = placed.groupBy("fingerprint").agg(F.max("anchor").alias("anchor"))
        old = state.latest("anchors", epoch)
        if old is not None:
            anchors = anchors.unionByName(old).groupBy("fingerprint").agg(F.max("anchor").alias("anchor"))
        passed = survivors.where(~F.col("throttled")).groupBy(F.unix_micros("timestamp").alias("t")).agg(
            F.count("*").alias("n"))
        if earlier is not None:
            passed = passed.unionByName(earlier).groupBy("t").agg(F.sum("n").alias("n"))
        newest = land(alerts.agg(F.max(F.unix_micros("timestamp")).alias("latest")))
        state.replace("anchors", epoch, _after(newest, anchors, "anchor", self.dedup_us + ALLOWED_LATENESS_US))
        latest = newest.first()["latest"]
        keep = passed if latest is None else passed.where(F.col("t") > latest - self.throttle_us - ALLOWED_LATENESS_US)
        state.replace("passed", epoch, keep)
        return done


def run_continuous(
    events: DataFrame, handler: ContinuousDetection, checkpoint: str, poll_seconds: int = POLL_SECONDS,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the job on a stream of unified events; ``available_now`` drains and stops."""
    writer = events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime=f"{poll_seconds} seconds")
    return writer.start()


def keep_running(start: Callable[[], StreamingQuery], pause_seconds: float = 10.0, attempts: int | None = None) -> int:
    """Restart a failed job from its checkpoint; returns the number of failures once it ends in order."""
    failures = 0
    while True:
        try:
            start().awaitTermination()
            return failures
        except StreamingQueryException as error:
            failures += 1
            log.error("continuous job failed, restarting: %s", error)
            if attempts is not None and failures >= attempts:
                raise
            time.sleep(pause_seconds)


def stream_sliding_counts(
    events: DataFrame, key: str, folder: str, checkpoint: str, lateness: str = "10 minutes",
    width: str = "5 minutes", slide: str = "1 minute",
) -> StreamingQuery:
    """Windowed counts per key, each window written once when the watermark has passed it."""
    counted = sliding_counts(events.withWatermark("timestamp", lateness), key, width, slide)
    return (
        counted.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
