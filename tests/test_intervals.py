from radiolake.operators.intervals import continuous_periods, gaps

SCHEMA = "device_id long, first_seen double, last_seen double, s string, e string, island int, blk int"


def brute(rows):
    by = {}
    for d, a, b in rows:
        if d is not None and a is not None and b is not None and a == a and b == b and b >= a:
            by.setdefault(d, []).append((a, b))
    periods, holes = [], []
    for d, v in by.items():
        v.sort()
        a, b, n = *v[0], 0
        for x, y in v:
            if x > b:
                periods.append((d, a, b, n))
                holes.append((d, b, x))
                a, b, n = x, y, 0
            b, n = max(b, y), n + 1
        periods.append((d, a, b, n))
    return sorted(periods), sorted(holes)


def run(spark, rows, as_rows, **kw):
    df = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)
    p = continuous_periods(df, "device_id", "first_seen", "last_seen", **kw)
    return as_rows(p, "device_id", "period_start", "period_end", "n_intervals"), as_rows(gaps(p, "device_id"))


def test_against_brute_force(spark, rng, as_rows):
    rows = []
    for d in range(15):
        for _ in range(60):
            a = float(rng.randrange(0, 500_000, 100))
            rows.append((d, a, a + rng.choice([0, 100, 1000, 30_000, -50])))
    rows += [(1, 0.0, 600_000.0)] + rng.choices(rows, k=40) + [(None, 1.0, 2.0), (2, None, 5.0), (2, 1.0, None), (2, float("nan"), 3.0), (2, 3.0, float("nan"))]
    for block in (86_400, 1_000, 10_000_000):
        assert run(spark, rows, as_rows, block_seconds=block) == brute(rows)


def test_touching_leaves_no_gap_and_any_length_is_one(spark, as_rows):
    assert run(spark, [(1, 0.0, 10.0), (1, 10.0, 20.0), (1, 20.25, 30.0)], as_rows) == ([(1, 0.0, 20.0, 2), (1, 20.25, 30.0, 1)], [(1, 20.0, 20.25)])


def test_nested_over_blocks(spark, as_rows):
    assert run(spark, [(1, 0.0, 1e6), (1, 500_000.0, 500_001.0), (1, 1_500_000.0, 1_500_000.0)], as_rows)[1] == [(1, 1e6, 1_500_000.0)]


def test_empty(spark, as_rows):
    assert run(spark, [], as_rows) == ([], [])
