from collections import Counter

import numpy as np
import pytest

from radiolake.llm.mixing import Shards, mix, sharded, split_quotas


def even(total, shards):
    return [total * k // shards for k in range(shards + 1)]


@pytest.mark.parametrize("blocks", [[1000, 37, 0, 1, 250], [3_000_000_000, 40, 0, 1, 1_700_000_001]])
def test_quotas_are_exact(blocks):
    for shards in (1, 2, 7, 64):
        ends = even(sum(blocks), shards)
        q = split_quotas(blocks, ends)
        assert q.sum(axis=0).tolist() == blocks
        assert q.sum(axis=1).tolist() == np.diff(ends).tolist()
        assert (q >= 0).all()
    assert np.array_equal(split_quotas(blocks, ends), split_quotas(blocks, ends))


def test_quotas_follow_the_shares():
    q = split_quotas([4_000_000_000, 1_000_000_000], even(5_000_000_000, 50))
    assert abs(q[:, 1] / q.sum(axis=1) - 0.2).max() < 0.001


@pytest.mark.parametrize("groups", [1, 5, 37, 4096])
def test_every_block_lies_in_the_shard_of_its_quota(spark, groups):
    shards = Shards.of([900, 13, 287], 37, 5, groups)
    rows = spark.createDataFrame([(i, s, 7) for i, n in enumerate(shards.blocks) for s in range(n)], "number int, spot long, other int").repartition(5)
    got = [(r["shard"], r["number"], r["spot"]) for r in sharded(spark, rows, shards).collect()]
    assert len(got) == 1200
    size = Counter(s for s, _, _ in got)
    assert [size[k] for k in range(37)] == np.diff(even(1200, 37)).tolist()
    assert [s for s, i, _ in sorted(got, key=lambda g: g[1:]) if i == 0] == sorted(s for s, i, _ in got if i == 0)  # disjoint ranges in order


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, source string, text string, n_tokens string, shard int").repartition(3)


def words(i, n):
    return " ".join(f"w{i}x{j}" for j in range(n))


@pytest.fixture
def tables(spark):
    docs = [(i, "Big " if i % 5 == 0 else "big", words(i, 20), "x", 1) for i in range(600)]
    docs += [(1000 + i, "small", words(1000 + i, 15), "x", 1) for i in range(40)]
    docs += [(2000 + i, " SMALL", words(1000 + i, 15), "x", 1) for i in range(10)]  # the same texts again
    docs += [(3000, "big", None, None, None), (3001, "big", "", "x", 1), (3002, None, "lost", "x", 1), (3003, "unknown", "lost", "x", 1), (3004, "  ", "lost", "x", 1)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, None)], "source string, target_share double, max_repeats int")
    return frame(spark, docs), targets


def test_shares_repeats_and_shards(spark, tables):
    mixed, report = mix(spark, *tables, block_tokens=256, blocks_per_shard=8)
    rows, shares = mixed.collect(), {r["source"]: r for r in report.collect()}
    assert shares["absent"]["tokens_mixed"] == 0 and shares["absent"]["texts"] == 0
    assert shares["big"]["actual_share"] == pytest.approx(0.6 / 0.9, abs=0.01)
    assert shares["small"]["actual_share"] == pytest.approx(0.3 / 0.9, abs=0.01)
    assert shares["small"]["texts"] == 40 and shares["small"]["most_copies"] == 3
    times = Counter(r["doc_id"] for r in rows)
    assert max(n for d, n in times.items() if d < 1000) == 1 and max(times.values()) == 3
    assert not set(times) & set(range(2000, 4000))
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r["shard"], []).append(r["position"])
    assert len(by_shard) > 3 and all(sorted(p) == list(range(1, len(p) + 1)) for p in by_shard.values())
    tokens = Counter()
    for r in rows:
        tokens[r["shard"]] += r["n_tokens"]
    assert max(tokens.values()) < 2 * 8 * 256


def test_same_mix_again(spark, tables):
    key = lambda m: sorted((r["shard"], r["position"], r["doc_id"], r["copy"]) for r in m.collect())
    assert key(mix(spark, *tables)[0]) == key(mix(spark, *tables)[0])


def test_groups_of_shards_make_the_same_kind_of_mix(spark, tables):
    mixed, report = mix(spark, *tables, block_tokens=128, blocks_per_shard=2, most_groups=3)
    shards = {r["shard"] for r in mixed.collect()}
    assert len(shards) > 20 and {r["source"]: r["most_copies"] for r in report.collect()}["small"] == 3


def test_smaller_total(spark, tables):
    _, report = mix(spark, *tables, total_tokens=3000)
    assert sum(r["tokens_mixed"] for r in report.collect()) == pytest.approx(3000, abs=200)


def test_empty(spark, tables):
    mixed, report = mix(spark, frame(spark, []), tables[1])
    assert mixed.collect() == [] and {r["tokens_mixed"] for r in report.collect()} == {0}
    none = tables[1].limit(0)
    assert mix(spark, tables[0], none)[0].collect() == []
