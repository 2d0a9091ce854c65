import statistics

import numpy as np
import pytest

from radiolake.operators.spikes import Model, suspicious_readings

T0 = 1735689600
SCHEMA = "id long, sniffer_id long, ts double, rssi int, source string, blk int, pos int"


def brute(rows):
    """Ids by the definition, straight from it."""
    out = {i for i, s, t, v in rows if v is not None and (v > 10 or v < -120)}
    by = {}
    for i, s, t, v in {r for r in rows if r[3] is not None and r[1] is not None and r[2] is not None and T0 <= r[2] < 1798761600}:
        by.setdefault(s, []).append((t, i, v))
    for readings in by.values():
        readings.sort()
        stuck, a = set(), 0
        for b in range(1, len(readings) + 1):
            if b == len(readings) or readings[b][2] != readings[a][2]:
                if b - a >= 12:
                    stuck |= {i for _, i, _ in readings[a:b]}
                a = b
        out |= stuck
        clean = [(t, i, v) for t, i, v in readings if i not in stuck and -120 <= v <= 10]
        for t, i, v in clean:
            others = [w for u, j, w in clean if abs(u - t) <= 21600 and j != i]
            if others and abs(v - statistics.median(others)) >= 20:
                out.add(i)
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = [r["id"] for r in suspicious_readings(spark, df, **kw).collect()]
    assert len(got) == len(set(got))
    return sorted(got)


def made(rng, n, sniffers=3, days=2.0):
    rows, t = [], {s: T0 + 1000.0 for s in range(sniffers)}
    stuck = {}
    for i in range(n):
        s = rng.randrange(sniffers)
        t[s] += rng.expovariate(n / sniffers / (days * 86400))
        level = -50 - 12 * s + (15 if t[s] > T0 + 86400 * days / 2 else 0)
        v = round(rng.gauss(level, 5))
        if s in stuck:
            v, left = stuck[s]
            stuck[s] = (v, left - 1)
            if left <= 1:
                del stuck[s]
        elif rng.random() < 0.004:
            stuck[s] = (v, rng.choice([9, 10, 11, 12, 30]))
        elif rng.random() < 0.03:
            v = level + rng.choice([19, 20, 21, -20, -35, 127, -90, 30])
        rows.append((i, s, round(t[s], 6), v))
    return rows


@pytest.mark.parametrize("block", [64, 2048])
def test_against_brute_force(spark, rng, block):
    rows = made(rng, 4000)
    rows += rng.choices(rows, k=200)  # second copies
    rows += [(10_001, None, T0 + 5.0, 127), (10_002, None, T0 + 5.0, -60), (10_003, 1, 5.0, -500), (10_004, 1, None, -60), (10_005, 1, T0 + 3.0, None), (10_006, 77, T0 + 9.0, -60)]
    rng.shuffle(rows)
    assert run(spark, rows, block=block) == brute(rows)


def test_many_copies_widen_the_halo(spark, rng):
    rows = made(rng, 600, sniffers=1)
    rows += [r for r in rows if 250 < r[0] < 400 for _ in range(90)]
    assert run(spark, rows, block=128) == brute(rows)


@pytest.mark.parametrize("before", [40, 41, 43])
def test_a_run_of_many_copies_across_block_edges(spark, before):
    rows = [(i, 1, T0 + 10.0 * i, -60 - i % 5) for i in range(before)] + [(100 + i, 1, T0 + 500.0 + i, -62) for i in range(12)] + [(200 + i, 1, T0 + 600.0 + 10.0 * i, -60 - i % 5) for i in range(40)]
    rows += [r for r in rows if 100 <= r[0] < 112 for _ in range(90)]
    got = run(spark, rows, block=128)
    assert got == brute(rows) and set(range(100, 112)) <= set(got)


def test_sparse_readings(spark, rng):
    rows = made(rng, 60, sniffers=2, days=20)
    assert run(spark, rows) == brute(rows)


def test_ties_in_time(spark, rng):
    rows = [(i, 1, T0 + float(i // 40), -60 if i % 40 < 14 else -60 - i % 7) for i in range(800)]
    assert run(spark, rows, block=64) == brute(rows)


def test_one_source_holds_most(spark, rng):
    rows = [(i, 1, T0 + i * 0.01, round(rng.gauss(-60, 4)) + (40 if i % 97 == 0 else 0)) for i in range(3000)]
    rows += [(5000 + i, 2, T0 + i * 60.0, -70 - i % 3) for i in range(20)]
    assert run(spark, rows, block=256) == brute(rows)


def test_empty_and_only_null(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, None, None), (2, 3, T0 + 1.0, None)]) == []
    assert run(spark, [(1, 1, T0 + 1.0, -60)]) == []


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(1)
    e, model = rng.random((5, 2, 4)), Model()
    p = model.forward_backward(e)
    for c in range(2):
        total = np.zeros((5, 4))
        for path in np.ndindex(4, 4, 4, 4, 4):
            w = model.start[path[0]] * e[0, c, path[0]]
            for t in range(1, 5):
                w *= model.transition[path[t - 1], path[t]] * e[t, c, path[t]]
            for t in range(5):
                total[t, path[t]] += w
        assert np.allclose(p[:, c], total / total.sum(axis=1, keepdims=True))


def test_reasons(spark, as_rows):
    rows = [(i, 1, T0 + 10.0 * i, -60 - i % 2) for i in range(50)] + [(100, 1, T0 + 5.0, -30), (101, 1, T0 + 6.0, 100)] + [(200 + i, 1, T0 + 2000.0 + i, -77) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, sniffer_id long, ts double, rssi int")
    got = as_rows(suspicious_readings(spark, df), "id", "reason")
    assert got == [(100, "spike"), (101, "range"), *[(200 + i, "stuck") for i in range(12)]]


def without(state):
    """The model without one state: nothing leads to it and nothing starts in it."""
    model = Model()
    transition, start = model.transition.copy(), model.start.copy()
    transition[:, state] = start[state] = 0
    return Model(transition / transition.sum(axis=1, keepdims=True), start / start.sum())


def test_the_model_decides(spark, rng):
    rows = made(rng, 3000)
    df = spark.createDataFrame(rows, "id long, sniffer_id long, ts double, rssi int")
    reasons = lambda m: {r["id"]: r["reason"] for r in suspicious_readings(spark, df, block=256, model=m).collect()}
    whole = reasons(Model())
    assert sorted(whole) == brute(rows) and set(whole.values()) == {"spike", "stuck", "range"}
    for state, name in ((1, "spike"), (2, "stuck")):
        assert name not in reasons(without(state)).values()  # neither bounds nor runs flag what the model can't be in
    shy = reasons(Model(anywhere=1e-16))  # spikes less likely than a normal reading that far off
    assert "spike" not in shy.values() and [i for i, r in whole.items() if r == "range"] == [i for i, r in shy.items() if r == "range"]
    assert set(reasons(Model(repeats=1.0, repeated=1e-9)).values()) == {"spike", "range"}  # a receiver that repeats itself in health
