"""Windows over hot keys, cut into blocks of the order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, by: list[str], order: str, block: int, name: str = "previous") -> DataFrame:
    """``rows`` with the value of ``order`` in the row before, within the same key; null for the first.

    The sort runs per (key, block of ``order``); a block's first row takes the greatest value of the blocks before, which comes from a window over
    one row per block. Null keys are a key; rows with a null ``order`` must be left out before.
    """
    cut = rows.withColumn("_blk", F.floor(F.col(order) / block))
    ends = cut.groupBy(*by, "_blk").agg(F.max(order).alias("_most"))
    carry = ends.select(*by, "_blk", F.max("_most").over(Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    joined = cut.join(carry, [cut[c].eqNullSafe(carry[c]) for c in [*by, "_blk"]]).select(cut["*"], "_carry")
    return joined.withColumn(name, F.coalesce(F.lag(order).over(Window.partitionBy(*by, "_blk").orderBy(order)), "_carry")).drop("_blk", "_carry")
