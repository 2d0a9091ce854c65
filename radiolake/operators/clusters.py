"""Sticky clusters: what a run's merges do to the clusters of earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from radiolake.operators.components import components

#: Vertices of existing clusters lie below all devices, in order of their ids.
BELOW = -(1 << 62)


def apply_run(decided: DataFrame, clusters: DataFrame, members: DataFrame, source: str = "auto") -> DataFrame:
    """``cluster_id, device_id`` after a run: unconfirmed clusters of the source go, the others take in what merges link to them.

    Clusters that merges link become one, under the smallest id; linked devices of no cluster form a new one, whose id is the greatest before plus
    its smallest device (unique without a global order). No merges, only the deletion. The partition doesn't depend on the order of merges.
    """
    kept = clusters.filter(~((F.col("source") == source) & ~F.coalesce("confirmed", F.lit(False)))).select(F.col("id").alias("cluster_id"))
    stay = members.join(kept, "cluster_id", "left_semi").select("cluster_id", "device_id")
    merges = decided.filter("outcome = 'merge'").select("a", "b")
    links = merges.unionAll(stay.select((F.col("cluster_id") + BELOW).alias("a"), F.col("device_id").alias("b")))
    whole = components(links)
    top = clusters.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = whole.filter(F.col("id") >= 0).join(F.broadcast(top))  # one row
    return numbered.select(F.when(F.col("root") < 0, F.col("root") - BELOW).otherwise(F.col("root") + F.col("top")).alias("cluster_id"), F.col("id").alias("device_id"))


def evidence(decided: DataFrame) -> DataFrame:
    """The highest-scoring decision that touches each device (of equal ones the first pair): ``device_id, score, a, b, profile``."""
    sides = decided.filter("score is not null").select(F.explode(F.array("a", "b")).alias("device_id"), "score", "a", "b", "profile")
    order = F.struct("score", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))
    return sides.groupBy("device_id").agg(F.max_by(F.struct("score", "a", "b", "profile"), order).alias("e")).select("device_id", "e.*")
