import math
import random

import numpy as np

from radiolake.llm import quantiles
from radiolake.llm.quantiles import SIZE, Sketch, combine, estimate, sketch

Q = {"p01": 0.01, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def check(values, got, q, error):
    v = np.sort(values)
    rank = max(1, math.ceil(q * len(v) - 1e-9))
    below, upto = np.searchsorted(v, got, "left"), np.searchsorted(v, got, "right")
    assert below < rank + error and upto >= rank - error


def test_bound_holds_and_is_small():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=600_000), np.full(200_000, 0.25), np.sort(rng.random(200_000))])
    parts = []
    for chunk in np.array_split(values, 13):
        s = Sketch()
        for piece in np.array_split(chunk, 9):
            s.add(piece)
        parts.append(s)
    whole = Sketch()
    for s in parts:
        for w, v in s.rows():
            whole.merge(w, v)
        whole.error += s.error
        whole.shrink()
    v = np.concatenate([b for _, b in whole.rows()])
    w = np.repeat([w for w, _ in whole.rows()], [len(b) for _, b in whole.rows()])
    order = np.argsort(v, kind="stable")
    upto = w[order].cumsum()
    assert upto[-1] == len(values)
    assert 0 < whole.error < 0.01 * len(values)
    for q in np.linspace(0.001, 1, 97):
        check(values, v[order][np.searchsorted(upto, max(1, math.ceil(q * len(values))))], q, whole.error)


def test_groups_in_a_table(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 8 + ["b", None]), rng.choice([None, *range(-90, -30)]), 1, 2) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "key string, value int, part int, weight int").repartition(40)
    monkeypatch.setattr(quantiles, "FAN_IN", 3)
    out = estimate(combine(sketch(df, ["key"], "value"), ["key"]), ["key"], Q)
    got = {r["key"]: r for r in out.collect()}
    assert set(got) == {"a", "b", None}
    for key, r in got.items():
        v = np.array([x for k, x, *_ in rows if k == key and x is not None])
        assert r["n"] == len(v)
        assert (r["rank_error"] == 0) or len(v) > SIZE
        for name, q in Q.items():
            check(v, r[name], q, r["rank_error"])


def test_days_combine_to_the_whole(spark):
    rows = [(i % 3, i % 7, float((i * 7919) % 10_007)) for i in range(40_000)]
    df = spark.createDataFrame(rows, "channel int, day int, v double")
    by_day = combine(sketch(df, ["channel", "day"], "v"), ["channel", "day"])
    assert by_day.select("channel", "day").distinct().count() == 21
    for r in estimate(combine(by_day, ["channel"]), ["channel"], Q).collect():
        v = np.array([x for c, _, x in rows if c == r["channel"]])
        assert r["n"] == len(v)
        for name, q in Q.items():
            check(v, r[name], q, r["rank_error"])


def test_small_groups_are_exact(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 7.0), (2, float("nan")), (2, None), (3, 1.0)], "k int, v double")
    got = {r["k"]: (r["n"], r["p50"], r["rank_error"]) for r in estimate(combine(sketch(df, ["k"], "v"), ["k"]), ["k"], Q).collect()}
    assert got == {1: (3, 7.0, 0.0), 3: (1, 1.0, 0.0)}


def test_empty(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert estimate(combine(sketch(df, ["k"], "v"), ["k"]), ["k"], Q).collect() == []
