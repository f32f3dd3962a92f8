"""Exact trailing-window counts that never put a whole key into one task.

Time is cut into slices. Per-slice totals (partially aggregated before the shuffle) give the
balance at the start of each slice; inside a slice only distinct instants are ordered, so one
window group holds at most one slice of one key. Slices that cannot exceed the floor are
dropped first; while the remaining ones fit a broadcast, no other event row is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.text import slot
from palisade.operators.joins import lookup_join
from palisade.session import land

SLICES = 60


def trailing_instants(
    events: DataFrame,
    keys: list[str],
    t_us: str,
    window_us: int,
    floor: int,
    weight: str | None = None,
    include_self: bool = False,
) -> DataFrame:
    """(keys, t, n, prior) per distinct instant: ``prior`` counts rows in the open (t - window, t).

    Returns the instants with ``prior`` (plus ``n`` when ``include_self``) above ``floor``.
    ``weight`` names a count column when the rows are already aggregated.
    """
    if window_us % SLICES:
        raise ValueError("the window must divide into slices")
    width = window_us // SLICES
    amount = F.sum(weight) if weight else F.count("*")
    rows = events.select(
        *keys, F.col(t_us).alias("t"), slot(F.col(t_us), width).alias("slice"),
        *([weight] if weight else []),
    )

    # What each slice opens with: everything in the full window before its start. Only slices that
    # can exceed the floor are kept; that table is landed so its size decides how it is joined.
    before = Window.partitionBy(*keys).orderBy("slice").rangeBetween(-SLICES, -1)
    opening = land(
        rows.groupBy(*keys, "slice").agg(amount.alias("own"))
        .withColumn("opening", F.coalesce(F.sum("own").over(before), F.lit(0)))
        .where(F.col("opening") + F.col("own") > floor)
        .drop("own")
    )

    # Each row arrives in its slice and expires one window later, in a slice of the same phase.
    moves = rows.withColumn("move", F.explode(F.array(
        F.struct(F.col("slice").alias("at"), F.col("t").alias("us"), F.lit(1).alias("sign")),
        F.struct((F.col("slice") + SLICES).alias("at"), (F.col("t") + window_us).alias("us"),
                 F.lit(-1).alias("sign")),
    ))).select(*keys, F.col("move.at").alias("slice"), F.col("move.us").alias("t"),
               F.col("move.sign").alias("sign"), *([weight] if weight else []))
    size = F.col(weight) if weight else F.lit(1)
    instants = (
        lookup_join(moves, opening, [*keys, "slice"], how="inner")
        .groupBy(*keys, "slice", "opening", "t")
        .agg(F.sum(F.when(F.col("sign") > 0, size).otherwise(0)).alias("n"),
             F.sum(F.when(F.col("sign") < 0, size).otherwise(0)).alias("gone"))
    )
    in_order = Window.partitionBy(*keys, "slice").orderBy("t")
    arrived = F.coalesce(F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    expired = F.sum("gone").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    counted = instants.withColumn("prior", F.col("opening") + arrived - expired).where(F.col("n") > 0)
    level = F.col("prior") + F.col("n") if include_self else F.col("prior")
    return counted.where(level > floor).select(*keys, "t", "n", "prior")


def trailing_hits(
    events: DataFrame, keys: list[str], window_us: int, floor: int, carry: list[str], count_name: str,
    t_us: str = "t_us", targets: Column | None = None,
) -> DataFrame:
    """The rows whose trailing count is above ``floor``, with the count as ``count_name``.

    ``targets`` restricts which rows may be reported (all rows still count)."""
    instants = (
        trailing_instants(events, keys, t_us, window_us, floor)
        .select(*keys, F.col("t").alias(t_us), F.col("prior").alias(count_name))
    )
    rows = events if targets is None else events.where(targets)
    return lookup_join(
        rows.select(*dict.fromkeys([*keys, t_us, *carry])), instants, [*keys, t_us],
        how="inner", measure=False,
    )
