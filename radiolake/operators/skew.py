"""Joins and cells that stay even when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key, or of one cell, that one task should hold at most.
MOST = 1_000_000


def hot(rows: DataFrame, keys: list[str], most: int = MOST) -> DataFrame:
    """``keys, parts`` of the keys with more than ``most`` rows and in how many parts they are cut; fewer than rows / ``most`` of them, so fit to broadcast."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    return counts.select(*keys, F.ceil(F.col("n") / most).cast("int").alias("parts"))


def attached(rows: DataFrame, table: DataFrame, key: str, by: str, most: int = MOST) -> DataFrame:
    """Left join of ``rows``, of which many may have one ``key``, with ``table``, a row per key: a hot key's rows are spread by the hash of ``by`` over
    copies of its row in the table. Null keys find nothing."""
    wide = F.broadcast(hot(rows.filter(F.col(key).isNotNull()), [key], most))
    parts = F.coalesce("parts", F.lit(1))
    left = rows.join(wide, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    right = table.join(wide, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left.join(right, [key, "_part"], "left").drop("_part")


def even_cells(rows: DataFrame, cell: str, by: list[str], most: int = MOST) -> DataFrame:
    """``rows`` with ``part`` beside ``cell``: cells of more than ``most`` rows are cut by the hash of the columns ``by``."""
    wide = F.broadcast(hot(rows, [cell], most))
    return rows.join(wide, cell, "left").withColumn("part", F.pmod(F.xxhash64(*by), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
