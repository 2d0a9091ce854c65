"""The project view: totals, names handed on without ambiguity, and clusters collapsed to their primaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from radiolake.functions.frames import lookup
from radiolake.functions.identity import KIND_RANK
from radiolake.runtime import Stage


def unambiguous(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key, picked``: the latest non-null value of each key, where the key has only one distinct value."""
    known = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    return known.groupBy(key).agg(F.max_by(value, F.struct(order, value)).alias("picked"), F.count_distinct(value).alias("n")).filter("n = 1").select(key, "picked")


def propagated(devices: DataFrame, everyone: DataFrame, members: DataFrame) -> DataFrame:
    """``devices`` with ``user_name`` and ``user_device_class`` handed on: names by cluster, then by local name; classes by cluster only.

    Sources are all devices, not just those shown. A cluster or local name with several different names hands on none.
    """
    of = members.groupBy("device_id").agg(F.max("cluster_id").alias("cluster_id"))
    inside = members.join(everyone.select(F.col("id").alias("device_id"), "user_name", "user_device_class", "last_seen"), "device_id")
    names = unambiguous(inside, "cluster_id", "user_name", "last_seen").withColumnRenamed("picked", "by_cluster")
    classes = unambiguous(inside, "cluster_id", "user_device_class", "last_seen").withColumnRenamed("picked", "class_by_cluster")
    local = unambiguous(everyone, "local_name", "user_name", "last_seen").withColumnRenamed("picked", "by_local_name")
    joined = devices.join(of, devices["id"] == of["device_id"], "left").drop("device_id").join(names, "cluster_id", "left").join(classes, "cluster_id", "left").join(local, "local_name", "left")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return joined.withColumns(
        {"user_name": F.coalesce(some("user_name"), "by_cluster", "by_local_name"), "user_device_class": F.coalesce(some("user_device_class"), "class_by_cluster")}
    ).withColumn("device_class", F.coalesce("user_device_class", "device_class")).drop("by_cluster", "class_by_cluster", "by_local_name")


def primaries(members: DataFrame, facts: DataFrame) -> DataFrame:
    """``cluster_id, device_id`` of the member that stands for its cluster: the most stable kind of address, most packets, latest sighting, smallest id."""
    rank = lookup(KIND_RANK, F.col("kind"), F.lit(5))
    order = F.struct((-rank).alias("r"), F.col("packet_count").alias("p"), F.col("last_seen").alias("l"), (-F.col("device_id")).alias("i"))
    return members.select("cluster_id", "device_id").join(facts, "device_id").groupBy("cluster_id").agg(F.max_by("device_id", order).alias("device_id"))


def collapsed(facts: DataFrame, members: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Totals per shown device, clusters of at least two shown members whose weakest score reaches the threshold as one row.

    ``facts``: ``device_id, kind, packet_count, adv_count, data_count, rssi_avg, rssi_min, rssi_max, last_seen``. A collapsed row stands under its primary,
    with counts added, extremes and the packet-weighted mean level of all; ``cluster_id`` and ``cluster_score`` tell membership either way.
    """
    live = members.select("cluster_id", "device_id", "score").join(facts, "device_id")
    judged = live.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.min("score").alias("cluster_score"))
    judged = judged.withColumn("merges", (F.col("members") >= 2) & F.coalesce(F.col("cluster_score") >= threshold, F.lit(False)))
    main = primaries(members, facts).withColumnRenamed("device_id", "primary_id")
    tag = live.select("device_id", "cluster_id").join(judged, "cluster_id").join(main, "cluster_id").withColumn("stands", F.when(F.col("merges"), F.col("primary_id")).otherwise(F.col("device_id")))
    tagged = facts.join(tag.select("device_id", "cluster_id", "cluster_score", "stands"), "device_id", "left").withColumn("stands", F.coalesce("stands", "device_id"))
    heard = F.when(F.col("rssi_avg").isNotNull(), F.col("packet_count"))
    return tagged.groupBy(F.col("stands").alias("device_id")).agg(
        F.sum("packet_count").alias("packet_count"), F.sum("adv_count").alias("adv_count"), F.sum("data_count").alias("data_count"),
        F.try_divide(F.sum(F.col("rssi_avg") * heard), F.sum(heard)).alias("rssi_avg"), F.min("rssi_min").alias("rssi_min"), F.max("rssi_max").alias("rssi_max"),
        F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("members"), F.max("cluster_id").alias("cluster_id"), F.min("cluster_score").alias("cluster_score"),
    )


def sort_keys() -> dict[str, Column]:
    """The orders a user may choose; missing values come last."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("~")))
    return {
        "Type": F.coalesce("device_class", F.lit("~")), "Name": F.lower("label"), "Address kind": F.coalesce("kind", F.lit("~")), "RSSI (avg)": F.desc(F.coalesce("rssi_avg", F.lit(-200.0))),
        "Vendor": low(F.coalesce(F.nullif(F.col("vendor"), F.lit("")), F.nullif(F.col("oui_vendor"), F.lit("")))), "Packets": F.desc("packet_count"), "Last seen": F.desc(F.coalesce("last_seen", F.lit(0.0))),
    }


def subtree(groups: DataFrame, root: int) -> DataFrame:
    """A group with all groups below it, however deep: ``id, depth``. Each level is written; a group met before (nested in a ring) isn't entered again."""
    levels = [Stage(groups.filter(F.col("id") == root).select("id", F.lit(0).alias("depth")).distinct(), "subtree")]
    while True:
        met = reduce(DataFrame.unionAll, [level.df for level in levels])
        below = groups.join(levels[-1].df.select(F.col("id").alias("parent_group_id")), "parent_group_id").select("id", F.lit(len(levels)).alias("depth")).distinct()
        following = Stage(below.join(met.select("id"), "id", "left_anti"), "subtree")
        if following.df.isEmpty():
            return met
        levels.append(following)


def looked_up(wanted: DataFrame, rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Point lookups of many keys at once: ``wanted`` (``key``) with the columns of the row of that key and ``found``; missing ones have nulls. The key is unique in ``rows``."""
    return wanted.select(key).distinct().join(rows.select(key, *columns, F.lit(True).alias("found")), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def at_either_end(wanted: DataFrame, links: DataFrame, a: str, b: str, key: str = "device_id") -> DataFrame:
    """Links one of whose ends is wanted, each with that end as ``key`` (twice where both are): two joins by equality rather than one by either condition."""
    keys = wanted.select(key).distinct()
    one = links.join(keys, F.col(a) == F.col(key))
    two = links.filter(~F.col(a).eqNullSafe(F.col(b))).join(keys, F.col(b) == F.col(key))
    return one.unionByName(two)


def newest_session(sessions: DataFrame) -> DataFrame:
    """The session started last (of equal ones the greatest id)."""
    return sessions.orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(1)


def shown_first(rows: DataFrame, key: str, order: Column, most: int = 12) -> DataFrame:
    """Per key the first ``most`` values and how many more there are: ``key, shown, more``."""
    w = Window.partitionBy(key).orderBy(order)
    n = rows.withColumn("_n", F.row_number().over(w))
    return n.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "value")))).alias("s"), F.greatest(F.lit(0), F.count(F.lit(1)) - most).alias("more")).select(key, F.transform("s", lambda x: x["value"]).alias("shown"), "more")
