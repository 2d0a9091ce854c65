"""Rollups of packets: observations, histograms, vocabulary, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def observations(packets: DataFrame, keys: list[str], *, ts: str = "ts", rssi: str = "rssi", is_advertising: Column) -> DataFrame:
    """Counters per key: packets, of them advertising and data, level extremes, sum and samples, first and last time.

    Null levels are no samples; an unknown PDU type counts as advertising (``is_advertising`` null). Times are the least and the greatest.
    """
    adv = F.coalesce(is_advertising, F.lit(True))
    return packets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packet_count"), F.count_if(adv).alias("adv_count"), F.count_if(~adv).alias("data_count"),
        F.min(rssi).alias("rssi_min"), F.max(rssi).alias("rssi_max"), F.sum(rssi).alias("rssi_sum"), F.count(rssi).alias("rssi_samples"),
        F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
    )


def histogram(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Long form of a histogram per key: ``keys, value, n``; null values are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def as_map(long: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A long histogram as one MAP per key, in order of the values; counts of equal values (several sessions) add up."""
    summed = long.groupBy(*keys, value).agg(F.sum("n").alias("n"))
    return summed.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(f"{value}_histogram"))


def merged_maps(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """MAP histograms of many rows added up per key."""
    long = rows.select(*keys, F.explode(column).alias("value", "n"))
    return as_map(long, keys, "value").withColumnRenamed("value_histogram", column)


def with_bad(observed: DataFrame, bad: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of corrupted packets (``keys, bad_packet_count, last_bad``) joined to the rollup; keys with only those get rows of zero packets."""
    joined = observed.join(bad, keys, "full_outer")
    counts = ["packet_count", "adv_count", "data_count", "bad_packet_count", "rssi_samples"]
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"first_seen": F.coalesce("first_seen", "last_bad"), "last_seen": F.greatest("last_seen", "last_bad")}).drop("last_bad")


def vocabulary(entries: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """First and last time and count of each entry (``keys``: device, type, value). Results of batches combine by :func:`combined`."""
    return entries.groupBy(*keys).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("count"))


def combined(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Vocabularies (or any first, last, count rollups) of several batches as one."""
    return parts.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("count").alias("count"))


def totals(observed: DataFrame, keys: list[str]) -> DataFrame:
    """Observations of several sessions as one row per key, with the mean level over all samples."""
    sums = ["packet_count", "adv_count", "data_count", "bad_packet_count"]
    return observed.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums if c in observed.columns], F.min("rssi_min").alias("rssi_min"), F.max("rssi_max").alias("rssi_max"),
        F.try_divide(F.sum("rssi_sum"), F.sum("rssi_samples")).alias("rssi_avg"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def fresh(observed: DataFrame, key: str, session: str, newest: Column, cutoff: Column) -> DataFrame:
    """Keys whose last sighting within the newest session isn't older than the cutoff. Clocks differ between sessions, so others don't count."""
    return observed.groupBy(key).agg(F.max(F.when(F.col(session) == newest, F.col("last_seen"))).alias("seen")).filter(F.col("seen") >= cutoff)


def most_common(rows: DataFrame, count: str, tie: list[str], n: int) -> DataFrame:
    """The ``n`` rows of the greatest count; of equal ones the smallest by ``tie``."""
    return rows.orderBy(F.desc(count), *tie).limit(n)


def in_order_met(rows: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """``key, values``: the distinct non-null values of each key in order of their first time (nulls last, equal ones by value)."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(ts).alias("_t"))
    entry = F.struct(F.col("_t").isNull().alias("n"), F.col("_t").alias("t"), F.col(value).alias("v"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]).alias("values"))
