import numpy as np
import pytest

from radiolake.operators.grid import regular_series

T0 = 1735689600
SCHEMA = "address_id long, ts double, rssi int, k string, slot int, m int, g int"


def brute(rows, least=1.5):
    by = {}
    for a, t, v in rows:
        if a is not None and t is not None and v is not None and T0 <= t < 1798761600:
            by.setdefault(a, []).append((t, float(v)))
    out = {}
    for a, r in by.items():
        t, y = np.array([x for x, _ in r]), np.array([v for _, v in r])
        s = np.floor(t / 600).astype(int)
        for g in range(s.min(), s.max() + 1):
            z = (t - (g * 600 + 300)) / 900
            near = abs(s - g) <= 1
            w = np.where(near, 1 - z * z, 0)
            s0, s1, s2, t0, t1, q = w.sum(), (w * z).sum(), (w * z * z).sum(), (w * y).sum(), (w * z * y).sum(), (w * w).sum()
            n, support = int((s == g).sum()), s0 * s0 / q if q > 1e-9 else 0.0
            fit = (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) if s0 * s2 - s1 * s1 > 0.1 * s0 * s2 and s0 > 1e-9 else t0 / s0 if s0 > 1e-9 else None
            status = "observed" if n else "filled" if support >= least else "missing"
            out[a, g * 600] = (n, support, fit if status != "missing" else None, status)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    return {(r["address_id"], r["slot"]): (r["n_readings"], r["support"], r["estimate"], r["status"]) for r in regular_series(df, "address_id", "ts", "rssi").collect()}


def test_against_direct_regression(spark, rng):
    rows = [(a, round(T0 + 86400 + rng.random() ** 2 * 40_000, 6), rng.randrange(-95, -40)) for a in range(6) for _ in range(40)]
    rows += rows[:20] + [(None, T0 + 1.0, -5), (1, None, -5), (1, 5.0, -5), (1, T0 + 86400.0, None), (77, T0 + 99.0, -50)]
    got, want = run(spark, rows), brute(rows)
    assert got.keys() == want.keys()
    assert {s for *_, s in want.values()} == {"observed", "filled", "missing"}
    for key, (n, support, fit, status) in want.items():
        assert got[key][0] == n and got[key][3] == status
        assert got[key][1] == pytest.approx(support, abs=1e-6)
        assert (got[key][2] is None) == (fit is None) and (fit is None or got[key][2] == pytest.approx(fit, abs=1e-6))


def test_line_is_met_exactly(spark):
    rows = [(1, T0 + 30.0 * i, -90 + i // 20) for i in range(400)]
    got = run(spark, [(1, T0 + 60.0 * i, -100 + i) for i in range(100)])
    inner = [v[2] - (-100 + (slot + 300 - T0) / 60) for (_, slot), v in sorted(got.items())][1:-1]
    assert max(map(abs, inner)) < 1e-6 and len(rows) == 400


def test_empty(spark):
    assert run(spark, []) == {}
