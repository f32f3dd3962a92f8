"""De-duplication with windows anchored at the first alert of each fingerprint.

The anchors of one fingerprint form a chain: the next anchor is the first alert at least one
window after the last. Only distinct instants matter, so alerts are first reduced to
(fingerprint, instant) counts. A fingerprint of few instants, as nearly all are, is folded over its sorted
instants in one pass. The chains of the others are followed by pointer doubling: every instant points to the
instant that would be the next anchor, and repeated joins on unique keys mark all chains in a
logarithmic number of rounds. Their instants are never gathered; what is ordered at once is one slice of a
fingerprint, a run of its occupied slices, or one row for each of its runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import slot
from palisade.operators.joins import lookup_join
from palisade.session import land, number_rows

WINDOW_US = 60 * 60_000_000
SLICES = 60

#: Instants of a fingerprint up to which they are folded in one row, and slices ordered at once.
FOLD, RUN = 512, 1024

FIRST = "struct<alertId:string,rowId:bigint>"


def instants_of(alerts: DataFrame, open_anchors: DataFrame | None = None) -> DataFrame:
    """(fingerprint, t, first, n) per distinct alert time; open anchors join with no first row."""
    points = alerts.groupBy("fingerprint", F.unix_micros("timestamp").alias("t")).agg(
        F.min(F.struct("alertId", "rowId")).alias("first"), F.count("*").alias("n"))
    if open_anchors is None:
        return points
    held = open_anchors.select("fingerprint", F.unix_micros("anchor").alias("t"),
                               F.lit(None).cast(FIRST).alias("first"), F.lit(0).cast("bigint").alias("n"))
    return points.unionByName(held).groupBy("fingerprint", "t").agg(
        F.when(F.min("n") > 0, F.min("first")).alias("first"), F.sum("n").alias("n"))


def _successors(points: DataFrame, window_us: int) -> tuple[DataFrame, DataFrame]:
    """(heads, jumps): chain starts, and for each instant the first instant a window later."""
    width = window_us // SLICES
    placed = points.select("fingerprint", "t", slot(F.col("t"), width).alias("slice"))
    ahead = placed.select("fingerprint", (F.col("t") + window_us).alias("x"), F.col("t").alias("origin"),
                          (F.col("slice") + SLICES).alias("slice"))
    # One row per occupied or targeted slice, knowing the first instant of every later slice.
    slices = (
        placed.groupBy("fingerprint", "slice").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
        .unionByName(ahead.groupBy("fingerprint", "slice").agg(F.lit(None).cast("bigint").alias("lo"),
                                                              F.lit(None).cast("bigint").alias("hi")))
        .groupBy("fingerprint", "slice").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    )
    slices = _with_neighbours(slices)
    heads = slices.where("lo is not null").where(
        F.col("prev_hi").isNull() | (F.col("lo") - F.col("prev_hi") >= window_us)
    ).select("fingerprint", F.col("lo").alias("t"))

    # Inside a slice, walk backwards: the last instant met at or after x is the successor.
    both = placed.select("fingerprint", "slice", F.col("t").alias("x"), F.lit(0).alias("probe"),
                         F.lit(None).cast("bigint").alias("origin")).unionByName(
        ahead.select("fingerprint", "slice", "x", F.lit(1).alias("probe"), "origin"))
    downwards = Window.partitionBy("fingerprint", "slice").orderBy(F.col("x").desc(), "probe").rowsBetween(
        Window.unboundedPreceding, 0)
    within = both.withColumn(
        "same", F.last(F.when(F.col("probe") == 0, F.col("x")), ignorenulls=True).over(downwards)
    ).where("probe = 1")
    jumps = (
        lookup_join(within, slices.select("fingerprint", "slice", "next_lo"), ["fingerprint", "slice"], measure=False)
        .select("fingerprint", F.col("origin").alias("t"), F.coalesce("same", "next_lo").alias("nxt"))
        .where("nxt is not null")
    )
    # Chains end where the next anchor is a head anyway.
    jumps = jumps.join(heads.select("fingerprint", F.col("t").alias("nxt")), ["fingerprint", "nxt"], "left_anti")
    return heads, jumps.select("fingerprint", "t", "nxt")


def _with_neighbours(slices: DataFrame) -> DataFrame:
    """Add ``prev_hi``, the last instant before a slice, and ``next_lo``, the first after it. Slices are ordered in runs; from
    run to run one row is carried."""
    placed = slices.withColumn("run", F.floor(F.col("slice") / RUN))
    inside, runs = Window.partitionBy("fingerprint", "run"), Window.partitionBy("fingerprint")
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (inside.orderBy("slice"), inside.orderBy(F.desc("slice"))))
    earlier, later = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (runs.orderBy("run"), runs.orderBy(F.desc("run"))))
    ends = placed.groupBy("fingerprint", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ends = ends.select("fingerprint", "run", F.last("hi", ignorenulls=True).over(earlier).alias("run_before"),
                       F.last("lo", ignorenulls=True).over(later).alias("run_after"))
    return placed.join(ends, ["fingerprint", "run"]).select(
        "fingerprint", "slice", "lo", "hi",
        F.coalesce(F.last("hi", ignorenulls=True).over(before), F.col("run_before")).alias("prev_hi"),
        F.coalesce(F.last("lo", ignorenulls=True).over(after), F.col("run_after")).alias("next_lo"))


def _folded(points: DataFrame, window_us: int) -> DataFrame:
    """The anchors of fingerprints with few instants."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("anchors"))

    def step(state, t):
        opens = state.last.isNull() | (t - state.last >= window_us)
        return F.when(opens, F.struct(t.alias("last"), F.concat(state.anchors, F.array(t)).alias("anchors"))).otherwise(state)

    sorted_instants = points.groupBy("fingerprint").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return sorted_instants.select("fingerprint", F.explode(F.aggregate("ts", start, step).anchors).alias("t"))


def anchors_of(points: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """(fingerprint, t): the instants that open a window."""
    points = points.select("fingerprint", "t")
    many = points.groupBy("fingerprint").count().where(F.col("count") > FOLD).select("fingerprint")
    if many.isEmpty():
        return _folded(points, window_us)
    many = land(many)
    few = _folded(points.join(many, "fingerprint", "left_anti"), window_us)
    return few.unionByName(_doubled(points.join(many, "fingerprint", "left_semi"), window_us))


def _doubled(points: DataFrame, window_us: int) -> DataFrame:
    """The same by pointer doubling: after k rounds the first 2^k anchors of every chain are known."""
    heads, jumps = _successors(points, window_us)
    reached, jumps = land(heads), land(jumps)
    while True:
        step = reached.join(jumps, ["fingerprint", "t"]).select("fingerprint", F.col("nxt").alias("t"))
        step = land(step)
        if step.isEmpty():
            return reached
        reached = land(reached.unionByName(step))
        onward = jumps.select("fingerprint", F.col("t").alias("nxt"), F.col("nxt").alias("far"))
        jumps = land(jumps.join(onward, ["fingerprint", "nxt"]).select(
            "fingerprint", "t", F.col("far").alias("nxt")))


def deduplicate(
    alerts: DataFrame, window_us: int = WINDOW_US, open_anchors: DataFrame | None = None,
) -> DataFrame:
    """Add ``anchor`` (start of the alert's window), ``duplicate`` and a unique ``rowId``.

    Of alerts at one instant the lowest alertId opens the window; of exact copies, one of them.
    ``open_anchors`` (fingerprint, anchor) carries the windows of earlier batches on."""
    alerts = number_rows(alerts)
    points = land(instants_of(alerts, open_anchors))
    anchors = anchors_of(points, window_us).join(
        points.select("fingerprint", "t", "first"), ["fingerprint", "t"])
    # A window covers its own slot and the next, and no slot holds two anchors, so each
    # (fingerprint, slot) needs at most two candidate anchors.
    slots = anchors.withColumn("slot", F.explode(F.array(
        slot(F.col("t"), window_us), slot(F.col("t"), window_us) + 1)))
    candidates = slots.groupBy("fingerprint", "slot").agg(
        F.min(F.struct("t", "first")).alias("early"), F.max(F.struct("t", "first")).alias("late"))
    placed = alerts.withColumn("__t", F.unix_micros("timestamp")).withColumn("slot", slot(F.col("__t"), window_us))
    joined = lookup_join(placed, candidates, ["fingerprint", "slot"], measure=False)
    chosen = F.when(F.col("late.t") <= F.col("__t"), F.col("late")).otherwise(F.col("early"))
    opens = (F.col("__a.t") == F.col("__t")) & F.col("__a.first.rowId").eqNullSafe(F.col("rowId"))
    return (
        joined.withColumn("__a", chosen)
        .withColumn("anchor", F.timestamp_micros(F.col("__a.t")))
        .withColumn("duplicate", ~opens)
        .drop("__a", "__t", "slot", "early", "late")
    )


def alert_groups(deduplicated: DataFrame) -> DataFrame:
    """Per window: how often the alert occurred, first and last time."""
    return deduplicated.groupBy("fingerprint", "anchor").agg(
        F.count("*").alias("occurrenceCount"),
        F.min("timestamp").alias("firstSeen"),
        F.max("timestamp").alias("lastSeen"),
    )
