"""Global rate limit: an alert passes while fewer than ``limit`` passed in the trailing window.

Only (instant, count) pairs enter, each count cut at ``limit`` (no more can pass at once). Time is cut into slices. A slice
whose own and preceding window's load stays within the limit is *calm*: its alerts all pass, and they never reach a fold.

What is left is one sequence, however long it is busy. It is cut into runs of slices, a window long at least, so that a run
needs nothing but what passed in the window before it, and short enough to hold a bounded number of instants; a run is one
row of packed numbers. Runs are folded in parallel on a guess of that state: what would pass if the window before the run
had begun empty. Then every guess is held against what did pass at the end of the run before, and runs that guessed wrong
are folded again from there. Where load comes and goes, guesses are right or repaired at once. Where the limit is reached
without a pause, the state of a week ago still shows in the state of today; such chains of neighbouring runs are what is
wrong after ``EAGER`` rounds, and they are streamed run by run, with one run and the state in memory. Either way ends
only when no guess is wrong.

Inside a run the rule is a running maximum instead of a loop. Let N count the alerts up to an instant, D those turned away,
and let p be the last instant that has left the window. Then D(t) = max(D before t, N(t) - N(p) - limit + D(p)), and for
all instants of one window D(p) is known before the first of them. So even a chain costs some ten nanoseconds an instant.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import slot
from palisade.operators.joins import lookup_join
from palisade.session import land, number_rows

HOUR_US = 3_600_000_000
LIMIT = 100
#: Slices of a window; instants a run should hold at most, and slices it has at most.
SLICES, RUN_ROWS, RUN_SLICES = 60, 250_000, 16_384
#: Rounds in which wrong runs are folded again side by side, before their chains are streamed.
EAGER = 2

_log = logging.getLogger(__name__)
_PACKED = "run long, points binary, tail binary"
_FOLDED = "run long, entered binary, left binary, passed binary"


def taken(t: np.ndarray, n: np.ndarray, limit: int, window_us: int) -> np.ndarray:
    """How many of the ``n`` alerts at each instant pass; instants ascend."""
    total = np.concatenate([[0], np.cumsum(n)])
    left = np.searchsorted(t, t - window_us, side="right")  # instants that are out of the window
    lost = np.zeros(len(t) + 1, np.int64)
    at = 0
    while at < len(t):
        end = int(np.searchsorted(t, t[at] + window_us))
        own = total[at + 1:end + 1] - total[left[at:end]] - limit + lost[left[at:end]]
        lost[at + 1:end + 1] = np.maximum.accumulate(np.maximum(own, lost[at]))
        at = end
    return n - np.diff(lost)


def _near_busy(points: DataFrame, limit: int, span: int) -> DataFrame:
    """Slices that a busy slice's instants can look back to, themselves included."""
    totals = points.groupBy("slice").agg(F.sum("n").alias("own"))
    loads = totals.select(F.explode(F.sequence("slice", F.col("slice") + span)).alias("slice"), "own").groupBy("slice").agg(F.sum("own").alias("load"))
    busy = totals.join(loads.where(F.col("load") > limit), "slice")
    return busy.select(F.explode(F.sequence(F.col("slice") - span, "slice")).alias("slice")).distinct()


def _pairs(packed: bytes | None) -> np.ndarray:
    """Instants and counts as two rows."""
    return np.frombuffer(packed or b"", np.int64).reshape(2, -1)


class Rule:
    """The fold of one run; ``length_us`` is how long a run is."""

    def __init__(self, limit: int, window_us: int, length_us: int):
        self.limit, self.window_us, self.length_us = limit, window_us, length_us

    def pass_through(self, points: np.ndarray, end: int) -> tuple[np.ndarray, bytes]:
        """What passes of ascending points, and of that what can still be seen at ``end``."""
        passed = np.stack([points[0], taken(points[0], points[1], self.limit, self.window_us)])
        passed = passed[:, passed[1] > 0]
        return passed, passed[:, passed[0] > end - self.window_us].tobytes()

    def pack(self, table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        points = np.stack([table["t"].to_numpy(), table["n"].to_numpy()])
        run = table["run"][0].as_py()
        tail = points[:, points[0] >= (run + 1) * self.length_us - self.window_us]
        return pa.table({"run": pa.array([run], pa.int64()), "points": pa.array([points.tobytes()], pa.binary()), "tail": pa.array([tail.tobytes()], pa.binary())})

    def run(self, run: int, points: bytes, entered: bytes) -> dict:
        """A run from what has passed before it: (instant, count) pairs, which all pass again."""
        state = _pairs(entered)
        passed, left = self.pass_through(np.concatenate([state, _pairs(points)], axis=1), (run + 1) * self.length_us)
        return {"run": run, "entered": entered, "left": left, "passed": passed[:, state.shape[1]:].tobytes()}

    def guess(self, run: int, points: bytes, tail: bytes | None) -> dict:
        return self.run(run, points, self.pass_through(_pairs(tail), run * self.length_us)[1])


def _each(rows: DataFrame, fold: Callable[..., dict]) -> DataFrame:
    """``fold`` of each row's columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row may be some megabytes
                yield pa.RecordBatch.from_pylist([fold(**{name: batch.column(name)[k].as_py() for name in batch.schema.names})], _ARROW)

    return rows.mapInArrow(work, _FOLDED)


_ARROW = pa.schema([("run", pa.int64()), ("entered", pa.binary()), ("left", pa.binary()), ("passed", pa.binary())])


def _streamed(rows: DataFrame, rule: Rule) -> DataFrame:
    """Chains of neighbouring runs, each run from the state the one before it left."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, b""
        for batch in batches:
            for run, points in zip(batch.column("run"), batch.column("points")):
                run = run.as_py()
                done = rule.run(run, points.as_py(), state if before == run - 1 else b"")
                before, state = run, done["left"]
                yield pa.RecordBatch.from_pylist([done], _ARROW)

    return rows.repartition("chain").sortWithinPartitions("chain", "run").select("run", "points").mapInArrow(work, _FOLDED)


def _wrong(folded: DataFrame) -> DataFrame:
    """(run, entered): runs that guessed wrong, with what the run before left."""
    before = folded.select((F.col("run") + 1).alias("run"), F.col("left").alias("right"))
    held = folded.select("run", "entered").join(before, "run", "left").withColumn("right", F.coalesce("right", F.lit(b"")))
    return held.where(F.col("entered") != F.col("right")).select("run", F.col("right").alias("entered"))


def _chains(folded: DataFrame, wrong: DataFrame) -> DataFrame:
    """(run, chain) of all unbroken sequences of runs that hold a wrong one; one row a run is ordered here."""
    ordered = Window.orderBy("run")
    numbered = folded.select("run").withColumn("chain", F.col("run") - F.row_number().over(ordered))
    return numbered.join(numbered.join(wrong, "run").select("chain").distinct(), "chain", "left_semi").select("run", "chain")


def _unpacked(folded: DataFrame) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column("passed"):
                t, take = _pairs(packed.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(take)], ["t", "take"])

    return folded.select("passed").mapInArrow(work, "t long, take long")


def passing_instants(points: DataFrame, limit: int = LIMIT, window_us: int = HOUR_US) -> DataFrame:
    """(t, take): how many alerts pass at each instant."""
    width = max(1, window_us // SLICES)
    span = -(-window_us // width)  # slices before its own that an instant's window can touch
    points = land(points.select("t", F.least("n", F.lit(limit)).cast("bigint").alias("n"), slot(F.col("t"), width).alias("slice")))
    near = land(_near_busy(points, limit, span))
    folds = points.join(near, "slice")
    most = folds.groupBy("slice").count().agg(F.max("count")).first()[0]
    if most is None:
        return points.select("t", F.col("n").alias("take"))
    length = max(span, min(RUN_SLICES, RUN_ROWS // most))
    rule = Rule(limit, window_us, length * width)
    packed = land(folds.select(F.floor(F.col("slice") / length).alias("run"), "t", "n").groupBy("run").applyInArrow(lambda table: rule.pack(table), _PACKED))
    tails = packed.select((F.col("run") + 1).alias("run"), "tail")
    folded = land(_each(packed.select("run", "points").join(tails, "run", "left"), rule.guess))
    rounds = 0
    while not (wrong := land(_wrong(folded))).isEmpty():
        if rounds < EAGER:
            redone = _each(packed.select("run", "points").join(wrong, "run"), rule.run)
        else:
            chains = land(_chains(folded, wrong))
            wrong, redone = chains, _streamed(packed.join(chains, "run"), rule)
        rounds += 1
        folded = land(folded.join(wrong.select("run"), "run", "left_anti").unionByName(redone))
    _log.info("throttling: runs of %d slices, %d rounds of repair", length, rounds)
    calm = points.join(near, "slice", "left_anti").select("t", F.col("n").alias("take"))
    return calm.unionByName(_unpacked(folded))


def throttle(
    alerts: DataFrame, limit: int = LIMIT, window_us: int = HOUR_US, earlier: DataFrame | None = None,
) -> DataFrame:
    """Add ``throttled`` and a unique ``rowId``; ties at one instant pass in order of alertId.

    ``earlier`` (t, n) holds alerts that passed in previous batches and still count."""
    rows = number_rows(alerts).withColumn("t", F.unix_micros("timestamp"))
    points = rows.groupBy("t").agg(F.count("*").alias("n"))
    if earlier is None:
        take = passing_instants(points, limit, window_us)
    else:
        held = earlier.groupBy("t").agg(F.sum("n").cast("bigint").alias("held"))
        both = points.join(held, "t", "full_outer").select(
            "t", (F.coalesce("n", F.lit(0)) + F.coalesce("held", F.lit(0))).alias("n"))
        take = passing_instants(both, limit, window_us).join(held, "t", "left").select(
            "t", (F.col("take") - F.coalesce("held", F.lit(0))).alias("take"))
    rank = Window.partitionBy("t").orderBy("alertId", "rowId")
    leading = rows.select("t", "alertId", "rowId").withColumn("rank", F.row_number().over(rank)).where(
        F.col("rank") <= limit)
    passing = leading.join(take, "t").where(F.col("rank") <= F.col("take")).select(
        "rowId", F.lit(True).alias("passes"))
    joined = lookup_join(rows, passing, ["rowId"], measure=False)
    return joined.withColumn("throttled", F.col("passes").isNull()).drop("passes", "t")


def outcomes(deduplicated: DataFrame, limit: int = LIMIT, window_us: int = HOUR_US) -> DataFrame:
    """End state of every alert: dispatched, deduplicated or throttled."""
    survivors = throttle(deduplicated.where(~F.col("duplicate")), limit, window_us)
    done = survivors.withColumn("outcome", F.when(F.col("throttled"), "throttled").otherwise("dispatched"))
    dropped = deduplicated.where("duplicate").withColumn("outcome", F.lit("deduplicated"))
    return done.drop("throttled").unionByName(dropped).drop("rowId")
