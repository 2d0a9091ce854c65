"""Connected components by rounds of local forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from radiolake.operators.skew import attached, even_cells
from radiolake.runtime import Stage

#: Links of one union-find at most; also the average size of a cell of links.
CELL_LINKS = 500_000


def roots(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, first_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links: each vertex with the first one (by ``first_*``, then id) of its component among them, where that is another."""
    vertices, at = np.unique(np.concatenate([a, b]), return_index=True)
    order = np.lexsort((vertices, np.concatenate([first_a, first_b])[at]))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    parent = list(range(len(vertices)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(place[np.searchsorted(vertices, a)].tolist(), place[np.searchsorted(vertices, b)].tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    root = np.fromiter(map(find, range(len(parent))), dtype=np.int64, count=len(parent))
    moved, ordered = np.flatnonzero(root != np.arange(len(root))), vertices[order]
    return ordered[moved], ordered[root[moved]]


def forests(most: int = CELL_LINKS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Union-find over a stream of links (``cell, a, b, fa, fb``) sorted by cell: one per cell, a cell of more than ``most`` links in several, so memory has a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        now, size = None, 0

        def done() -> pa.RecordBatch:
            v, r = roots(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(r, pa.int64())], names=["v", "r"])

        for batch in batches:
            cell, *rest = (batch.column(i).to_numpy() for i in range(5))
            cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else []
            for i, j in zip(cuts, [*cuts[1:], len(cell)]):
                if held and (cell[i] != now or size >= most):
                    yield done()
                    size = 0
                now = cell[i]
                held.append([x[i:j] for x in rest])
                size += j - i
        if held:
            yield done()

    return run


def local_forests(links: DataFrame, cell: F.Column, most: int = CELL_LINKS) -> DataFrame:
    """``v, r``: the first vertex of each other vertex's component inside its cell of ``links`` (``a, b``); oversized cells are cut by the hash of the link."""
    celled = even_cells(links.withColumn("cell", cell), "cell", ["a", "b"], 2 * most)
    named = celled.select(F.xxhash64("cell", "part").alias("cell"), "a", "b", F.xxhash64("a").alias("fa"), F.xxhash64("b").alias("fb"))
    return named.repartition("cell").sortWithinPartitions("cell").mapInArrow(forests(most), "v long, r long")


def by_first(links: DataFrame, n: int, most: int = CELL_LINKS) -> DataFrame:
    """Local forests of cells by the hash of the end that comes first in the order, so that stars lie together."""
    first = F.least(F.struct(F.xxhash64("a"), F.col("a").alias("v")), F.struct(F.xxhash64("b"), F.col("b").alias("v")))["v"]
    return local_forests(links, F.pmod(F.xxhash64(F.lit(1), first), F.lit(max(1, -(-n // most)))), most)


def contract(pairs: DataFrame, a: str, b: str, local: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """``root, member`` of every vertex of a link, root being the smallest id of its component.

    Vertices have a fixed random order (a hash). Each round, ``local`` gives the vertices of the links (``a, b``) and their number a representative ``r`` that
    comes before them, of each cell they are in. The first of a vertex's representatives becomes its parent, and the others are linked to that
    parent. Vertices that represent none leave the links for good; only those that do keep the link to their parent. So links and
    vertices shrink from round to round whatever the ids are, and a settled star costs nothing more. When no links are left, parents are
    resolved from the last round to the first, and components are named by their smallest ids. Joins on a parent or a root, of which a giant
    component has only one, are spread (:func:`radiolake.operators.skew.attached`).
    """
    x, y = F.col("a"), F.col("b")

    def written(df: DataFrame) -> tuple[Stage, int]:
        seen = Observation()
        ordered = df.filter(x != y).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
        return Stage(ordered.observe(seen, F.count(F.lit(1)).alias("n")), "links"), seen

    links, seen = written(pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter(x.isNotNull() & y.isNotNull()))
    steps: list[Stage] = []
    while n := seen.get["n"]:
        told = Stage(local(links.df, n), "representatives")
        best = F.min(F.struct(F.xxhash64("r").alias("o"), F.col("r").alias("p"))).alias("m")
        parents = Stage(told.df.groupBy("v").agg(best, F.count(F.lit(1)).alias("n")).select("v", "m.p", "n"), "parents")
        crossing = told.df.join(parents.df.filter("n > 1").select("v", "p"), "v").filter("r <> p").select(F.col("r").alias("a"), F.col("p").alias("b"))  # a vertex is in few cells
        kept = parents.df.join(told.df.select(F.col("r").alias("v")).distinct(), "v", "left_semi").select(F.col("v").alias("a"), F.col("p").alias("b"))
        before = links
        links, seen = written(crossing.unionAll(kept))
        steps.append(parents)
        for old in (before, told):
            old.drop()
    if not steps:
        return links.df.select(y.alias("root"), x.alias("member"))
    found = steps.pop()
    found = Stage(found.df.select("v", F.col("p").alias("root")), "roots")
    for parents in reversed(steps):
        up = attached(parents.df.select("v", "p"), found.df.select(F.col("v").alias("p"), "root"), "p", "v")
        both = up.select("v", F.coalesce("root", "p").alias("root")).unionAll(found.df.select("v", "root"))
        following = Stage(both.groupBy("v").agg(F.min("root").alias("root")), "roots")  # a vertex told twice has one root
        found.drop()
        parents.drop()
        found = following
    least = found.df.groupBy("root").agg(F.least("root", F.min("v")).alias("least"))
    members = attached(found.df, least, "root", "v").select(F.col("least").alias("root"), F.col("v").alias("member"))
    return members.unionAll(least.select(F.col("least").alias("root"), F.col("root").alias("member")))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, root`` of every vertex of an edge; the root is the smallest id of its component.

    Null ends and loops link nothing; repeats count once; no edges, no rows. Method: :func:`contract` with cells by the end that comes first.
    """
    return contract(edges, a, b, by_first).select(F.col("member").alias("id"), "root")
