"""Queries of the problems 4, 5, 8, 9 and 10, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radiolake.llm import abuse, grouping, mixing, quantiles, tokens
from radiolake.runtime import TIME_FROM, TIME_TO, is_valid_time, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FRACTIONS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings once for each kind of key: ``key_column, key_value, rssi``."""
    packets = read(spark, sf_dir, "packets")
    keys = F.array(*[F.struct(F.lit(k).alias("key_column"), F.col(k).cast("long").alias("key_value")) for k in ("channel", "device_id")])
    return packets.filter("rssi is not null").select(F.explode(keys).alias("k"), "rssi").select("k.*", "rssi").filter("key_value is not null")


@query(
    """SELECT key_column, key_value, count(*) AS n, 0.0::DOUBLE AS rank_error, """
    + ", ".join(f"CAST(quantile_disc(rssi, {q}) AS DOUBLE) AS {name}" for name, q in FRACTIONS.items())
    + """ FROM (SELECT 'channel' AS key_column, CAST(channel AS BIGINT) AS key_value, rssi FROM packets UNION ALL SELECT 'device_id', device_id, rssi FROM packets) WHERE rssi IS NOT NULL AND key_value IS NOT NULL GROUP BY ALL"""
)
def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the level per channel and per device, with the bound of their rank error.

    The SQL is exact, so it says the same wherever no key fills more than the buffers and every bound is 0 (40,000 packets do not; 400,000 do).
    """
    keys = ["key_column", "key_value"]
    return quantiles.estimate(quantiles.combine(quantiles.sketch(_levels(spark, sf_dir), keys, "rssi"), keys), keys, FRACTIONS)


@query(
    f"SELECT channel, CAST(count(*) AS BIGINT) AS n, TRUE AS within FROM packets WHERE rssi IS NOT NULL AND channel IS NOT NULL AND ts >= {TIME_FROM} AND ts < {TIME_TO} GROUP BY channel"
)
def p4_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of single days combined per channel, each percentile held against exact ranks: ``within`` its bound or not."""
    rows = read(spark, sf_dir, "packets").filter(is_valid_time(F.col("ts")) & F.col("rssi").isNotNull() & F.col("channel").isNotNull()).withColumn("day", F.floor(F.col("ts") / 86400))
    by_day = quantiles.combine(quantiles.sketch(rows, ["channel", "day"], "rssi"), ["channel", "day"])
    est = quantiles.estimate(quantiles.combine(by_day, ["channel"]), ["channel"], FRACTIONS)
    asked = est.select("channel", "n", "rank_error", F.explode(F.array(*[F.struct(F.lit(q).alias("q"), F.col(name).alias("v")) for name, q in FRACTIONS.items()])).alias("e")).select("*", "e.*").drop("e")
    counts = rows.groupBy("channel", "rssi").agg(F.count(F.lit(1)).alias("m"))
    ranks = asked.join(counts, "channel").groupBy("channel", "n", "rank_error", "q").agg(F.sum(F.when(F.col("rssi") < F.col("v"), F.col("m")).otherwise(0)).alias("below"), F.sum(F.when(F.col("rssi") <= F.col("v"), F.col("m")).otherwise(0)).alias("upto"))
    target = F.ceil(F.col("q") * F.col("n") - 1e-9)
    ok = (F.col("below") < target + F.col("rank_error")) & (F.col("upto") >= target - F.col("rank_error"))
    return ranks.groupBy("channel", "n").agg(F.bool_and(ok).alias("within"))


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of known devices that some verdict merged."""
    known = read(spark, sf_dir, "devices").select(F.col("id").alias("known"))
    pairs = read(spark, sf_dir, "merge_decisions").filter("is_merge and a_id <> b_id").select("a_id", "b_id")
    return pairs.join(known, F.col("a_id") == F.col("known"), "left_semi").join(known, F.col("b_id") == F.col("known"), "left_semi")


_REACH = """
WITH RECURSIVE e AS (SELECT a_id AS a, b_id AS b FROM merge_decisions WHERE is_merge AND a_id <> b_id AND a_id IN (SELECT id FROM devices) AND b_id IN (SELECT id FROM devices)),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(n, m) AS (SELECT a, a FROM s UNION SELECT s.b, r.m FROM r JOIN s ON r.n = s.a),
g AS (SELECT min(m) AS group_id, n AS device_id FROM r GROUP BY n)
"""


@query(_REACH + "SELECT group_id, device_id FROM g")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every device linked to another."""
    return grouping.consolidate(_merges(spark, sf_dir), "a_id", "b_id").withColumnRenamed("member", "device_id")


@query(
    _REACH
    + """SELECT group_id, count(DISTINCT g.device_id) AS n_devices, count(DISTINCT c.cluster_id) AS n_clusters, min(c.cluster_id) AS cluster_id
    FROM g LEFT JOIN device_cluster_members c ON c.device_id = g.device_id GROUP BY group_id"""
)
def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group with the headers that earlier runs spread its devices over; the smallest is comparable with ``device_clusters.id``."""
    groups = p5_found(spark, sf_dir)
    members = read(spark, sf_dir, "device_cluster_members").select("cluster_id", "device_id")
    return groups.join(members, "device_id", "left").groupBy("group_id").agg(F.count_distinct("device_id").alias("n_devices"), F.count_distinct("cluster_id").alias("n_clusters"), F.min("cluster_id").alias("cluster_id"))


@query()
def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(spark, read(spark, sf_dir, "documents"))


@query("SELECT doc_id, TRUE AS same FROM documents")
def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether decoding a document's ids gives back its text (an empty one for null)."""
    documents = read(spark, sf_dir, "documents")
    back = tokens.decode(spark, tokens.encode(spark, documents)).withColumnRenamed("text", "decoded")
    return documents.select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


@query()
def p8_source_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens per source name."""
    documents = read(spark, sf_dir, "documents").select("doc_id", mixing.canonical("source").alias("source"), "text")
    return tokens.count_tokens(spark, documents).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))


@query()
def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest mix at target weights, in shuffled shards."""
    return mixing.mix(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[0]


@query()
def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares the mix reached."""
    return mixing.mix(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))[1]


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    model = abuse.train(documents, read(spark, sf_dir, "abuse_labels"))
    return abuse.score(spark, documents.select("doc_id", mixing.canonical("source").alias("source"), "text"), model)


@query()
def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with abusive, hateful or sexual content."""
    return _scored(spark, sf_dir).filter("abusive").select("doc_id")


@query()
def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document."""
    return _scored(spark, sf_dir)


@query()
def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the share flagged per source."""
    return _scored(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("int")).alias("rate"))
