"""Pairwise matches consolidated into groups, on a two-dimensional grid of edge blocks."""

from __future__ import annotations

from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radiolake.operators.components import CELL_LINKS, contract, local_forests


def grid_side(n: int, cell_pairs: int, cores: int = 1) -> int:
    """Blocks of vertices: enough for cells of about ``cell_pairs`` pairs, and where there is work for them (a hundredth of that a cell) for all cores to have cells."""
    return max(1, ceil(sqrt(n / cell_pairs)), min(ceil(sqrt(cores)), int(sqrt(n * 100 / cell_pairs))))


def consolidate(pairs: DataFrame, a: str, b: str, cell_pairs: int = CELL_LINKS) -> DataFrame:
    """``group_id, member`` for every record linked to another, directly or through others; the group is its smallest member.

    Method: vertices are hashed to ``side`` blocks, and the pairs between two blocks form one cell of a grid. Every cell runs
    union-find on its own pairs. A vertex then has a representative from each cell of its row and
    column; the first of them (in a fixed random order) becomes its parent, the others are linked to that parent, and vertices that represent no other leave. The next round has
    the links that are left, on a grid for their number, until none is left (:func:`radiolake.operators.components.contract`). A hub is
    spread over the cells of its row and column, cells with more than twice their share are cut, and no step collects a component or pairs its members.

    Defined results: pairs with a null end and pairs of a record with itself link nothing; repeats and either order count once; no pairs, no
    groups. Ids are LONG. Other columns are not read.
    """
    cores = pairs.sparkSession.sparkContext.defaultParallelism

    def on_grid(links: DataFrame, n: int) -> DataFrame:
        side = grid_side(n, cell_pairs, cores)
        block = lambda v: F.pmod(F.xxhash64(F.lit(2), v), F.lit(side))
        x, y = block(F.col("a")), block(F.col("b"))
        cell: Column = F.least(x, y) * side + F.greatest(x, y)
        return local_forests(links, cell, cell_pairs)

    return contract(pairs, a, b, on_grid).select(F.col("root").alias("group_id"), "member")
