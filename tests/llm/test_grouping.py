import random

import pytest

from radiolake.llm.grouping import consolidate, grid_side


def brute(pairs):
    parent = {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        for x in (a, b):
            parent.setdefault(x, x)
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((find(x), x) for x in parent)


def run(spark, pairs, **kw):
    df = spark.createDataFrame([(*p, "x", 1) for p in pairs], "a_id long, b_id long, a string, cell int")
    return sorted(map(tuple, consolidate(df, "a_id", "b_id", **kw).collect()))


@pytest.mark.parametrize("cell_pairs", [40, 500_000])
def test_random_graphs(spark, cell_pairs):
    rng = random.Random(cell_pairs)
    pairs = [(rng.randrange(600), rng.randrange(600)) for _ in range(280)] + [(700, 700), (None, 4), (4, None), (5, 6), (6, 5), (5, 6)]
    assert run(spark, pairs, cell_pairs=cell_pairs) == brute(pairs)


def test_chain_over_many_cells(spark):
    ids = list(range(1000, 1200))
    random.Random(1).shuffle(ids)
    pairs = list(zip(ids, ids[1:]))
    assert run(spark, pairs, cell_pairs=5) == brute(pairs)


def test_hub_and_negative_ids(spark):
    pairs = [(-5, i) for i in range(300)] + [(10_000 + i, i) for i in range(0, 300, 7)]
    assert run(spark, pairs, cell_pairs=20) == brute(pairs)


def test_nothing_linked(spark):
    assert run(spark, []) == [] == run(spark, [(1, 1), (None, None)])


def test_one_group_holds_most_vertices(spark):
    """A hub of 40,000 members, far more than a cell may hold: the greatest union-find stays at its bound, and every member is found."""
    rng = random.Random(3)
    pairs = [(-7, i) for i in range(40_000)] + [(50_000 + i, rng.randrange(40_000)) for i in range(2_000)] + [(90_000, 90_001)]
    got = consolidate(spark.createDataFrame(pairs, "a_id long, b_id long"), "a_id", "b_id", cell_pairs=1000)
    assert got.groupBy("group_id").count().rdd.collectAsMap() == {-7: 42_001, 90_000: 2}


def test_monotone_chain_ends(spark):
    pairs = [(i, i + 1) for i in range(3000)]
    assert run(spark, pairs, cell_pairs=50) == [(0, i) for i in range(3001)]


def test_grid_grows_with_pairs_and_cores():
    assert grid_side(100, 500_000, 12) == 1 and grid_side(400_000, 500_000, 12) == 4 and grid_side(10**9, 500_000, 12) == 45
