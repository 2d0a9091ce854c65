"""Merging overlapping intervals and listing the gaps between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def continuous_periods(rows: DataFrame, key: str, start: str, end: str, block_seconds: int = 86_400) -> DataFrame:
    """Merge the intervals of each key into continuous periods.

    Returns ``key, period_start, period_end, previous_end, n_intervals``; ``previous_end`` is the end of the
    key's period before (null for its first), so that a gap is ``previous_end .. period_start``.

    Method: sort by start within a key, compare each start with the running maximum of the ends before it, label
    islands with a running count, aggregate. A key may hold a third of all rows, so no window runs over a whole
    key: the sort runs per (key, block of starts), and what a block needs from those before it (the greatest end,
    the number of islands) comes from a window over one row per block.

    Defined results: rows with a null key, a null or NaN bound or an end before the start don't count; intervals
    that touch are one period; intervals of no length count; repeated rows only raise ``n_intervals``.
    Other columns of ``rows`` are not read.
    """
    s, e = F.col("s"), F.col("e")
    base = (
        rows.select(F.col(key).alias("k"), F.col(start).alias("s"), F.col(end).alias("e"))
        .filter(F.col("k").isNotNull() & s.isNotNull() & e.isNotNull() & ~F.isnan(s.cast("double")) & ~F.isnan(e.cast("double")) & (e >= s))
        .withColumn("blk", F.floor(s / block_seconds))
    )
    earlier = Window.partitionBy("k").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("k", "blk").orderBy("s", "e")
    carried = base.groupBy("k", "blk").agg(F.max("e").alias("most")).select("k", "blk", F.max("most").over(earlier).alias("carry"))
    started = (
        base.join(carried, ["k", "blk"])
        .withColumn("before", F.greatest("carry", F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))))
        .withColumn("opens", (F.col("before").isNull() | (s > F.col("before"))).cast("long"))
    )
    opened = started.groupBy("k", "blk").agg(F.sum("opens").alias("n")).select("k", "blk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("islands"))
    counting = Window.partitionBy("k", "blk").orderBy("s", "e", F.desc("opens")).rowsBetween(Window.unboundedPreceding, 0)  # of equal rows the one that opens comes first
    labelled = started.join(opened, ["k", "blk"]).withColumn("island", F.col("islands") + F.sum("opens").over(counting))
    return (
        labelled.groupBy("k", "island")
        .agg(F.min("s").alias("period_start"), F.max("e").alias("period_end"), F.max(F.when(F.col("opens") == 1, F.col("before"))).alias("previous_end"), F.count(F.lit(1)).alias("n_intervals"))
        .select(F.col("k").alias(key), "period_start", "period_end", "previous_end", "n_intervals")
    )


def gaps(periods: DataFrame, key: str) -> DataFrame:
    """The stretches no interval covers, from the result of :func:`continuous_periods`: ``key, gap_start, gap_end``."""
    return periods.filter("previous_end is not null").select(key, F.col("previous_end").alias("gap_start"), F.col("period_start").alias("gap_end"))
