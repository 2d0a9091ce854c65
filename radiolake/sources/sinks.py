"""Writing: text in parts of bounded size, and all tables of an ingest at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def text(lines: DataFrame, path: str, most_lines: int = 1_000_000) -> None:
    """Lines (``value``) as text files of at most so many lines each."""
    lines.select("value").write.option("maxRecordsPerFile", most_lines).mode("append").text(path)


def text_by_size(lines: DataFrame, path: str, most_bytes: int, order: str, block: int = 100_000) -> DataFrame:
    """Lines (``value``, in ``order``, whole numbers) as text in folders ``part=<n>`` of at most ``most_bytes`` of UTF-8 each, as a sink rotates that looks at its size before it
    writes; ``part, lines, bytes`` comes back. A line larger than the bound has a part to itself.

    Sizes are cumulated per block of the order, over sums per block, so no task holds all lines. A part begins where the running size passes a multiple of half the bound, so a
    line of at most half the bound never overfills it.
    """
    half = max(1, most_bytes // 2)
    sized = lines.select("value", F.col(order).alias("o"), (F.octet_length(F.encode("value", "UTF-8")) + 1).alias("n")).withColumn("blk", F.floor(F.col("o") / block))
    before = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sized.groupBy("blk").agg(F.sum("n").alias("n")).select("blk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carry"))  # a row per block
    inside = Window.partitionBy("blk").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.join(carried, "blk").withColumn("start", F.col("carry") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    parts = placed.withColumn("part", F.floor(F.col("start") / half))
    alone = F.when(F.col("n") > half, F.concat(F.col("part").cast("string"), F.lit("-"), F.col("o").cast("string"))).otherwise(F.col("part").cast("string"))
    named = parts.withColumn("part", alone)
    named.repartition("part").sortWithinPartitions("part", "o").select("part", "value").write.partitionBy("part").mode("append").text(path)
    return named.groupBy("part").agg(F.count(F.lit(1)).alias("lines"), F.sum("n").alias("bytes"))


def _fs(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def swap(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """Writes all tables beside the old ones and then moves each into place; rows by table. A failure before the moves leaves the old tables.

    A table is never missing for good: the old one is moved aside before the new one takes its place and deleted after all have; :func:`table` reads it where a move
    was cut short.
    """
    counts: dict[str, int] = {}
    staged: dict[str, str] = {}
    for name, df in tables.items():
        seen = Observation()
        staged[name] = f"{root}/_staged-{uuid.uuid4().hex}-{name}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(staged[name])
        counts[name] = seen.get["n"]
    spark = next(iter(tables.values())).sparkSession if tables else None
    for name, staged_at in staged.items():
        (target, fs), (old, _), (new, _) = _fs(spark, f"{root}/{name}.parquet"), _fs(spark, f"{root}/_old-{name}.parquet"), _fs(spark, staged_at)
        if fs.exists(target):
            fs.delete(old, True)
            if not fs.rename(target, old):
                raise OSError(f"{target} can't be moved aside")
        if not fs.rename(new, target):
            fs.rename(old, target)
            raise OSError(f"{new} can't be moved to {target}")
    for name in staged:
        old, fs = _fs(spark, f"{root}/_old-{name}.parquet")
        fs.delete(old, True)
    return counts


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table :func:`swap` wrote; the old one if its move was cut short."""
    path, fs = _fs(spark, f"{root}/{name}.parquet")
    return spark.read.parquet(f"{root}/{name}.parquet" if fs.exists(path) else f"{root}/_old-{name}.parquet")
