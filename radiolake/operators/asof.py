"""As-of attribution of corrupted packets, by blocks of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attribute(packets: DataFrame, by: list[str], order: str, ts: str, ok: str, device: str, tolerance: float = 2.0, block: int = 3600) -> DataFrame:
    """Each corrupted packet with the device of the last sound packet before it on the same ``by`` (source, channel): ``credited``, null if none is near.

    "Before" is by ``order`` (arrival, unique); the age, by ``ts`` (seconds), must not exceed the tolerance, and a negative age passes.
    Rows are scanned per (by, block of arrivals); what a block starts from comes from a window over one row per block, so a
    source with most packets is spread over its blocks.
    """
    w = Window.partitionBy(*by, "blk").orderBy(order)
    rows = packets.withColumn("blk", F.floor(F.col(order) / block))
    sound = F.when(F.col(ok) & F.col(device).isNotNull(), F.struct(F.col(device).alias("device"), F.col(ts).alias("ts")))
    last = rows.groupBy(*by, "blk").agg(F.max_by(sound, F.when(sound.isNotNull(), F.col(order))).alias("last"))
    carried = last.select(*by, "blk", F.last("last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    same = [rows[c].eqNullSafe(carried[c]) for c in [*by, "blk"]]
    joined = rows.join(carried, same).select(rows["*"], "carry")
    seen = joined.withColumn("before", F.coalesce(F.last(sound, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "carry"))
    return seen.filter(~F.col(ok)).withColumn("credited", F.when(F.col(ts) - F.col("before.ts") <= tolerance, F.col("before.device"))).drop("blk", "carry", "before")
