import math
from collections import Counter

from pyspark.sql import functions as F

from radiolake.operators.frequency import heavy_keys, profile, value_frequencies

SCHEMA = "device_id long, rssi int, key string, value string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_against_brute_force(spark, rng, as_rows):
    rows = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(-90, -60)])) for _ in range(3000)] + [(9, None)]
    got = {r["key"]: r for r in profile(value_frequencies(frame(spark, rows), "device_id", "rssi"), {"p10": 0.1, "p50": 0.5, "p100": 1.0}).collect()}
    assert set(got) == {1, 2, 3, 9}
    for key, r in got.items():
        v = sorted(x for k, x in rows if k == key and x is not None)
        c = Counter(v)
        assert (r["n_rows"], r["n_values"], r["n_distinct"]) == (sum(k == key for k, _ in rows), len(v), len(c))
        assert r["mode"] == (min(c, key=lambda x: (-c[x], x)) if c else None)
        assert [r["p10"], r["p50"], r["p100"]] == ([v[math.ceil(q * len(v)) - 1] for q in (0.1, 0.5, 1.0)] if v else [None] * 3)


def test_hot_key_of_many_distinct_values(spark):
    df = spark.range(0, 50_000).selectExpr("1L as device_id", "cast(id as int) as rssi").union(spark.range(0, 10).selectExpr("2L", "cast(5 as int)"))
    got = {r["key"]: (r["n_distinct"], r["p50"]) for r in profile(value_frequencies(df, "device_id", "rssi")).collect()}
    assert got == {1: (50_000, 24_999), 2: (1, 5)}


def test_heavy_keys(spark, as_rows):
    rows = [(1, 5)] * 10 + [(2, None)] * 6 + [(3, 1)] * 5 + [(None, 1)] * 79
    assert as_rows(heavy_keys(value_frequencies(frame(spark, rows), "device_id", "rssi"))) == [(1, 10), (2, 6)]
    assert as_rows(heavy_keys(value_frequencies(frame(spark, []), "device_id", "rssi"))) == []
    assert as_rows(profile(value_frequencies(frame(spark, []), "device_id", "rssi"))) == []


def test_several_key_columns_share_a_scan(spark, rng, as_rows):
    df = spark.createDataFrame([(rng.choice([1, 1, 2, None]), rng.choice([7, 8]), rng.choice([None, -60, -61, -70])) for _ in range(500)], "a long, b int, v int")
    both = value_frequencies(df, ["a", "b"], "v")
    columns = ["key", "n_rows", "n_values", "n_distinct", "mode", "p50"]
    for k in ("a", "b"):
        one = value_frequencies(df, k, "v")
        assert as_rows(profile(both).filter(F.col("key_column") == k), *columns) == as_rows(profile(one), *columns)
        assert as_rows(heavy_keys(both, 0.3).filter(F.col("key_column") == k), "key", "n_rows") == as_rows(heavy_keys(one, 0.3), "key", "n_rows")
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
