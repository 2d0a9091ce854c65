from radiolake.operators.activity import activity_sessions

T0 = 1735689600
SCHEMA = "device_id long, ts double, k string, b int, us int, p int"


def brute(events, gap=1800):
    by = {}
    for d, ts in events:
        if d is not None and ts is not None and ts == ts and T0 <= ts < 1798761600:
            by.setdefault(d, []).append(round(ts * 1e6))
    out = []
    for d, times in by.items():
        times.sort()
        start, last, n = times[0], times[0], 0
        for t in times:
            if t - last > gap * 1_000_000:
                out.append((d, start, last, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((d, start, last, n))
    return sorted(out)


def run(spark, events, as_rows):
    df = spark.createDataFrame([(d, ts, "x", 1, 2, 3) for d, ts in events], SCHEMA)
    return as_rows(activity_sessions(df, "device_id", "ts"))


def test_against_brute_force(spark, rng, as_rows):
    events = []
    for d in range(20):
        t = T0 + rng.random() * 1e5
        for _ in range(200):
            t += rng.choice([rng.random() * 100, 1800, 1800.000001, rng.random() * 4000, 900])
            events.append((d, round(t, 6)))
    events += rng.choices(events, k=50) + [(None, T0 + 5.0), (3, None), (3, 12.0), (3, 1798761600.0), (3, float("nan"))]
    rng.shuffle(events)
    assert run(spark, events, as_rows) == brute(events)


def test_exact_gap_does_not_split(spark, as_rows):
    assert run(spark, [(1, T0 + 0.1), (1, T0 + 1800.1), (1, T0 + 3600.100001)], as_rows) == [(1, (T0 * 10 + 1) * 100_000, (T0 * 10 + 18001) * 100_000, 2), (1, T0 * 1_000_000 + 3600_100_001, T0 * 1_000_000 + 3600_100_001, 1)]


def test_long_chain_is_one_session(spark, as_rows):
    events = [(1, T0 + 1000.0 * i) for i in range(2000)]
    assert run(spark, events, as_rows) == brute(events)


def test_empty(spark, as_rows):
    assert run(spark, [], as_rows) == []
    assert run(spark, [(None, None)], as_rows) == []
