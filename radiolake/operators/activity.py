"""Activity sessions by pointer doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from radiolake.runtime import MICROS, Stage, floor_div, is_valid_time, micros


def activity_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """Split each key's events into sessions wherever more than ``gap_seconds`` lie between neighbours.

    Returns ``key, start_us, end_us, n_events``: one row per session, times in epoch microseconds.

    Method: pointer doubling. Events of a key that fall into one time bucket as wide as the gap are always
    of one session, so they are combined first (map-side, which also flattens hot keys: a key keeps at most one
    row per bucket, however many events it has). A bucket can only follow on from the bucket right before it, so
    the link to a predecessor within the gap is an equi-self-join, without any per-key sort. Pointers are then
    joined with themselves, each round doubling the distance covered, until none is open; the root is the session.
    A round holds only the open pointers and the settled ones that were looked up in the round before (along a session of
    neighbouring buckets no other can be looked up again), so short sessions leave the loop at once and the rounds of a
    session that lasts for months touch only its own buckets.

    Defined results: rows with a null key or without a valid time are no events; repeated rows count as often
    as they are stored and never change bounds; exactly ``gap_seconds`` does not split; no rows, no sessions.
    Other columns of ``events`` are not read.
    """
    gap = gap_seconds * MICROS
    nodes = Stage(
        events.filter(is_valid_time(F.col(ts)) & F.col(key).isNotNull())
        .select(F.col(key).alias("k"), micros(F.col(ts)).alias("us"))
        .withColumn("b", floor_div(F.col("us"), gap))
        .groupBy("k", "b")
        .agg(F.min("us").alias("mn"), F.max("us").alias("mx"), F.count(F.lit(1)).alias("n")),
        "activity-nodes",
    )
    before = nodes.df.select("k", (F.col("b") + 1).alias("b"), F.col("mx").alias("before_mx"))
    follows = F.coalesce(F.col("mn") - F.col("before_mx") <= gap, F.lit(False))
    first = nodes.df.join(before, ["k", "b"], "left").select("k", "b", F.when(follows, F.col("b") - 1).otherwise(F.col("b")).alias("p"), (~follows).alias("done"), F.lit(True).alias("own"))
    left = Observation()
    rounds = [Stage(first.observe(left, F.count_if(~F.col("done")).alias("n")), "activity-pointers")]
    while left.get["n"]:
        now, left = rounds[-1].df, Observation()
        target = now.select("k", F.col("b").alias("p"), F.col("p").alias("pp"), F.col("done").alias("settled"))
        row = lambda b, p, done, own: F.struct(b.alias("b"), p.alias("p"), done.alias("done"), F.lit(own).alias("own"))
        met = now.filter("not done").select("k", "b", "p").join(target, ["k", "p"])
        looked_up = F.when(F.col("settled"), row(F.col("p"), F.col("pp"), F.col("settled"), False))
        both = F.filter(F.array(row(F.col("b"), F.col("pp"), F.col("settled"), True), looked_up), lambda x: x.isNotNull())
        rounds.append(Stage(met.select("k", F.explode(both).alias("r")).select("k", "r.*").observe(left, F.count_if(~F.col("done")).alias("n")), "activity-pointers"))
    rooted = reduce(DataFrame.unionAll, [r.df.filter("own and done").select("k", "b", "p") for r in rounds])
    return (
        nodes.df.join(rooted, ["k", "b"])
        .groupBy("k", "p")
        .agg(F.min("mn").alias("start_us"), F.max("mx").alias("end_us"), F.sum("n").alias("n_events"))
        .select(F.col("k").alias(key), "start_us", "end_us", "n_events")
    )
