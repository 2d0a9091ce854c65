"""Mixing sources to target weights, with exact block quotas split over output shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from radiolake.llm.tokens import VOCABULARY, count_tokens
from radiolake.runtime import materialize

SEED = 20_250_101
#: Groups of shards whose quotas are split on the driver; it bounds that table, not the number of shards.
MOST_GROUPS = 4096


def canonical(source: str) -> F.Column:
    """A source name without case and outer blanks; blank names are null."""
    name = F.lower(F.regexp_replace(F.col(source), r"^\s+|\s+$", ""))
    return F.when(name != "", name)


#: The generator's draws are refused from so many blocks on; larger nodes are dealt in bundles.
MOST_DRAWN = 500_000_000


def _draw(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """How many blocks of each source are among ``n`` dealt from all.

    More than ``MOST_DRAWN`` blocks are dealt in bundles of equal size, what is over (a bundle and a bit of each source) singly; sums stay exact.
    """
    total = int(have.sum())
    if total < MOST_DRAWN:
        return rng.multivariate_hypergeometric(have, n, method="marginals")
    size = -(-total // MOST_DRAWN) * 2
    bundles = np.maximum(0, have // size - 1)
    whole = min(int(bundles.sum()), n // size)
    return rng.multivariate_hypergeometric(bundles, whole, method="marginals") * size + _draw(rng, have - bundles * size, n - whole * size)


def split_quotas(blocks: list[int], ends: list[int], seed: int | list[int] = SEED) -> np.ndarray:
    """Blocks of each source for each shard (shards, sources), by a multivariate-hypergeometric splitting tree; ``ends``: blocks up to each shard, from 0 to all.

    A node's shards are halved; how many blocks of each source go left is one draw of the left half's total from the node's blocks, as if
    all were shuffled and dealt. Row sums (what ``ends`` gives a shard) and column sums (all blocks used once) are exact.
    """
    rng = np.random.default_rng(seed)
    shards = len(ends) - 1
    quotas = np.zeros((shards, len(blocks)), dtype=np.int64)
    todo = [(0, shards, np.array(blocks, dtype=np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            quotas[a] = have
            continue
        m = (a + b) // 2
        left = _draw(rng, have, ends[m] - ends[a])
        todo += [(a, m, left), (m, b, have - left)]
    return quotas


def _upto(quotas: np.ndarray) -> np.ndarray:
    """Blocks of each source before each shard, and all of them in the last row."""
    return np.vstack([np.zeros(quotas.shape[1], dtype=np.int64), quotas.cumsum(axis=0)])


@dataclass(frozen=True)
class Shards:
    """``shards`` shards of equal size, up to one block, over the ``blocks`` of each source, in at most ``MOST_GROUPS`` groups of neighbouring ones.

    The quotas of the groups (``upto``: groups + 1 rows, a column per source) are split at once and sent to all tasks, a bounded table. Those of a
    group's shards are split where its rows are. With a shard a group the second step falls away.
    """

    blocks: list[int]
    shards: int
    seed: int
    groups: int
    upto: np.ndarray

    @classmethod
    def of(cls, blocks: list[int], shards: int, seed: int, most_groups: int) -> Shards:
        groups, total = min(shards, most_groups), sum(blocks)
        ends = [total * (shards * g // groups) // shards for g in range(groups + 1)]
        return cls(blocks, shards, seed, groups, _upto(split_quotas(blocks, ends, seed)))

    def inside(self, group: int) -> tuple[int, np.ndarray]:
        """First shard of a group, and the blocks of each source before each of its shards."""
        a, b, total = self.shards * group // self.groups, self.shards * (group + 1) // self.groups, sum(self.blocks)
        ends = [total * k // self.shards - total * a // self.shards for k in range(a, b + 1)]
        quotas = split_quotas((self.upto[group + 1] - self.upto[group]).tolist(), ends, [self.seed, group])
        return a, self.upto[group] + _upto(quotas)


def _look_up(column: str, kind: pa.DataType, find: Callable[[np.ndarray, np.ndarray, pa.RecordBatch], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds a column found from the source's number and the spot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = find(b.column("number").to_numpy(), b.column("spot").to_numpy(), b) if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], names=[*b.schema.names, column])

    return run


def sharded(spark: SparkSession, copies: DataFrame, shards: Shards) -> DataFrame:
    """``copies`` (``number`` of the source, ``spot`` of the block, others) with the ``shard`` of their block, without a table of blocks."""
    given = spark.sparkContext.broadcast(shards)  # at most MOST_GROUPS rows, a number per source
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in copies.schema.fields)

    def group_of(number: np.ndarray, spot: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        out, upto = np.empty(len(spot), dtype=np.int64), given.value.upto
        for i in np.unique(number):
            out[number == i] = np.searchsorted(upto[:, i], spot[number == i], side="right") - 1
        return out

    grouped = copies.mapInArrow(_look_up("grp", pa.int64(), group_of), f"{kinds}, grp long")
    if shards.groups == shards.shards:
        return grouped.withColumnRenamed("grp", "shard")

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}

        def find(number: np.ndarray, spot: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            grp, out = batch.column("grp").to_numpy(), np.empty(len(spot), dtype=np.int64)
            for g in np.unique(grp).tolist():
                if g not in held:
                    held.clear()  # rows come group by group
                    held[g] = given.value.inside(g)
                first, upto = held[g]
                for i in np.unique(number[grp == g]):
                    at = (grp == g) & (number == i)
                    out[at] = first + np.searchsorted(upto[:, i], spot[at], side="right") - 1
            return out

        yield from _look_up("shard", pa.int64(), find)(batches)

    return grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(shard_of, f"{kinds}, grp long, shard long").drop("grp")


def _permutation(n: int, seed: int) -> tuple[int, int]:
    """(factor, shift) of a permutation x -> (factor x + shift) mod n of the blocks of a source."""
    rng = np.random.default_rng(seed)
    while True:
        f = int(rng.integers(1, max(2, n)))
        if gcd(f, n) == 1:
            return f, int(rng.integers(0, n))


def mix(
    spark: SparkSession,
    documents: DataFrame,
    targets: DataFrame,
    total_tokens: int | None = None,
    block_tokens: int = 16_384,
    blocks_per_shard: int = 64,
    most_groups: int = MOST_GROUPS,
    vocabulary: str = VOCABULARY,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """A mix in which each source has its target share of all tokens, and the report of the shares reached.

    ``documents`` has ``doc_id, source, text``; ``targets`` has ``source, target_share, max_repeats`` (one row per source, few: it is collected).
    The mix is ``shard, position, doc_id, copy, source, n_tokens``; the report ``source, target_share, texts, tokens_available, tokens_mixed,
    actual_share, most_copies``, a row per target.

    Without ``total_tokens`` the mix is as large as the scarcest source allows with its repeats; a larger total is lowered to that. A source is
    used once through, then a second time, up to ``max_repeats``; the last round stops at the quota, to within half a document.

    Method: each source's texts are put in a random order (a keyed hash) and its quota cut into blocks of about ``block_tokens``; the
    block counts are split exactly over the shards, of ``blocks_per_shard`` blocks each however many there are, by a multivariate-hypergeometric tree, its upper part
    (``most_groups`` groups of shards) on the driver and the rest where the rows are; every shard takes disjoint ranges of each source's
    permuted blocks and shuffles its documents. The running sums that place a text in its source run per (source, hash bucket) over
    bucket sums, so a source with a third of all rows is spread over all tasks.

    Defined results: names of sources are compared without case and outer blanks; rows without source, with one that is no target, or with
    null or empty text aren't mixed; equal texts (under any ids, in any sources) are one text, of the smallest doc_id; a target without texts
    reports zeros, and the others share its part in proportion; a null max_repeats is 1; no documents, an empty mix. Other columns are not read.
    """
    wanted = {r["name"]: (r["target_share"], 1 if r["max_repeats"] is None else r["max_repeats"]) for r in targets.withColumn("name", canonical("source")).collect() if r["name"] and r["target_share"]}
    names = sorted(wanted)
    asked = documents.select("doc_id", canonical("source").alias("source"), "text").filter(F.col("source").isin(names) & (F.col("text") != ""))
    counted = count_tokens(spark, asked.select("doc_id", "source", F.sha2("text", 256).alias("digest"), "text"), vocabulary=vocabulary)
    texts = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("d")).select("d.*").filter("n_tokens > 0")
    texts = materialize(texts.withColumn("order", F.xxhash64(F.lit(seed), "doc_id")), "mix-texts")

    buckets = max(16, texts.count() // 20_000)
    placed = texts.withColumn("bucket", F.floor((F.col("order") / 2.0**64 + 0.5) * buckets))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(placed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts")).withColumn("carry", F.coalesce(F.sum("tokens").over(along), F.lit(0))), "mix-buckets")
    have = {r["source"]: (r["tokens"], r["texts"]) for r in sums.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("texts").alias("texts")).collect()}

    usable = [s for s in names if s in have and wanted[s][1] > 0]
    share = {s: wanted[s][0] / sum(wanted[u][0] for u in usable) for s in usable}
    total = min((have[s][0] * wanted[s][1] / share[s] for s in usable), default=0.0)
    if total_tokens is not None:
        total = min(total, total_tokens)
    quota = {s: share[s] * total for s in usable}
    blocks = [int(quota[s] // block_tokens) + 1 for s in usable]
    shards = max(1, -(-sum(blocks) // blocks_per_shard))
    plan = []
    for i, s in enumerate(usable):
        factor, shift = _permutation(blocks[i], seed + i)
        plan.append((s, i, int(have[s][0]), float(quota[s]), int(wanted[s][1]), blocks[i], factor, shift))
    plan_df = spark.createDataFrame(plan, "source string, number int, available long, quota double, repeats int, blocks long, factor long, shift long")

    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(sums.select("source", "bucket", "carry"), ["source", "bucket"]).withColumn("before", F.col("carry") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    copies = (
        at.join(F.broadcast(plan_df), "source")  # one row per target
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("repeats", F.lit(1)))))
        .withColumn("where", (F.col("copy") - 1) * F.col("available") + F.col("before"))
        .filter(F.col("where") + F.col("n_tokens") / 2 <= F.col("quota") + 0.5)
        .withColumn("spot", F.pmod(F.least(F.floor(F.col("where") / block_tokens), F.col("blocks") - 1) * F.col("factor") + F.col("shift"), F.col("blocks")))
    )
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy"), "doc_id", "copy")
    placed = sharded(spark, copies.select("number", "spot", "doc_id", "copy", "source", "n_tokens"), Shards.of(blocks or [0], shards, seed, most_groups))
    mixed = placed.withColumn("shard", F.col("shard").cast("int")).withColumn("position", F.row_number().over(local))
    mixed = materialize(mixed.select("shard", "position", "doc_id", "copy", "source", "n_tokens"), "mix")

    reached = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_mixed"), F.max("copy").alias("most_copies"))
    base = spark.createDataFrame([(s, float(wanted[s][0]), *map(int, reversed(have.get(s, (0, 0))))) for s in names], "source string, target_share double, texts long, tokens_available long")
    report = base.join(reached, "source", "left").select(
        "source", "target_share", "texts", "tokens_available", F.coalesce("tokens_mixed", F.lit(0)).alias("tokens_mixed"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
    whole = F.sum("tokens_mixed").over(Window.partitionBy(F.lit(1)))  # a row per target
    return mixed, report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens_mixed"), whole), F.lit(0.0)))
