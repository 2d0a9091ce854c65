"""Per-key results without skew, by value-frequency compression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from radiolake.runtime import materialize


def value_frequencies(rows: DataFrame, key: str | list[str], value: str) -> DataFrame:
    """``key, value, n``: how often each key holds each value; with a list of key columns ``key_column, key, value, n`` for all of them.

    Grouping by key and value before key spreads a hot key over its values, and map-side combining shrinks it to
    one row per value before anything is shuffled, so what follows per key is as large as its distinct values. Several key
    columns (whole numbers) share one scan and one shuffle. Null values are kept (they count as rows of the key), and so are null keys, which
    :func:`profile` leaves out.
    """
    if isinstance(key, str):
        return rows.groupBy(F.col(key).alias("key"), F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    each = F.array(*[F.struct(F.lit(k).alias("key_column"), F.col(k).cast("long").alias("key")) for k in key])
    return rows.select(F.explode(each).alias("k"), F.col(value).alias("value")).groupBy("k.key_column", "k.key", "value").agg(F.count(F.lit(1)).alias("n"))


def _by(frequencies: DataFrame) -> list[str]:
    return ["key_column", "key"] if "key_column" in frequencies.columns else ["key"]


def profile(frequencies: DataFrame, fractions: dict[str, float] | None = None) -> DataFrame:
    """Exact per-key results from weighted values: ``[key_column,] key, n_rows, n_values, n_distinct, mode, <name of each fraction>``.

    Percentiles are the smallest value that at least that share of the key's non-null values doesn't exceed. Of equally
    frequent values the smallest is the mode. A key with only null values has null results and zero counts. Null keys have no row.

    A hot key may also have very many distinct values, so no window runs over a whole key: the weighted values are cut into ranges by (key, value) and written
    with their range's number; running weights are sums over the ranges before plus a window inside the range.
    """
    fractions = {"p50": 0.5} if fractions is None else fractions
    by = _by(frequencies)
    f = frequencies.filter("key is not null").withColumn("v_n", F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0))
    f = materialize(f.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()), "frequencies")
    parts = f.groupBy(*by, "part").agg(F.sum("v_n").alias("part_n"))
    before = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(*by, "part", F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("carry"), F.sum("part_n").over(Window.partitionBy(*by)).alias("total"))
    inside = Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = f.join(carried, [*by, "part"]).withColumn("upto", F.col("carry") + F.sum("v_n").over(inside))
    known = F.col("value").isNotNull()
    aggs = [
        F.sum("n").alias("n_rows"),
        F.sum("v_n").alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(known, F.struct((-F.col("n")).alias("a"), F.col("value").alias("b")))).alias("mode"),
    ]
    aggs += [F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * F.lit(q)), F.col("value"))).alias(name) for name, q in fractions.items()]
    return ranked.groupBy(*by).agg(*aggs)


def heavy_keys(frequencies: DataFrame, share: float = 0.05) -> DataFrame:
    """``[key_column,] key, n_rows``: keys that hold more than ``share`` of all rows, from :func:`value_frequencies`.

    Null keys count in the whole, but have no row. The whole (one row per key column) is summed from the same counts per key, whose shuffle both sides of
    the join read: no condition on the key reaches down to it, or the two sides would each scan the rows.
    """
    by = _by(frequencies)
    counts = frequencies.groupBy(*by).agg(F.sum("n").alias("n_rows"))
    whole = counts.groupBy(*by[:-1]).agg(F.sum("n_rows").alias("all_rows"))
    joined = counts.join(F.broadcast(whole), by[:-1]) if by[:-1] else counts.join(F.broadcast(whole))  # a row per key column
    return joined.filter(F.when(F.col("key").isNotNull(), F.col("n_rows")) > F.col("all_rows") * share).select(*by, "n_rows")
