"""Comparison of a query with its SQL, run by another engine on the same files."""

from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def value(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    return tuple(map(value, v)) if isinstance(v, list) else v


def same(spark, query, sql, data=DATA):
    duckdb = __import__("pytest").importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in data.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = Counter(tuple(value(r[i]) for i in sorted(range(len(names)), key=names.__getitem__)) for r in result.fetchall())
    df = query(spark, str(data))
    assert sorted(df.columns) == sorted(names)
    got = Counter(tuple(map(value, r)) for r in df.select(*sorted(names)).collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
