"""Components at the edges of cells, and joins of hot keys."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from radiolake.operators.components import by_first, components, contract, forests
from radiolake.operators.skew import attached, even_cells


def test_small_cells_take_several_rounds(spark, rng, as_rows):
    edges = [(i, i + 1) for i in range(1500)] + [(5000, 6000 + i) for i in range(800)] + [(rng.randrange(7000, 7400), rng.randrange(7000, 7400)) for _ in range(300)]
    df = spark.createDataFrame(edges, "a long, b long")
    small = contract(df, "a", "b", lambda links, n: by_first(links, n, 40)).select(F.col("member").alias("id"), "root")
    assert as_rows(small) == as_rows(components(df))
    assert {r["root"] for r in small.filter("id < 1501").collect()} == {0} and small.filter("root = 5000").count() == 801


def test_a_cell_is_cut_at_its_bound():
    n = 1000
    link = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.full(len(a), 3))] + [pa.array(np.asarray(x, dtype=np.int64)) for x in (a, b, a, b)], names=["cell", "a", "b", "fa", "fb"])
    batches = [link(range(i + 1, i + 51), [0] * 50) for i in range(0, n, 50)]
    out = list(forests(100)(iter(batches)))
    assert len(out) == n // 100 and all(b.num_rows == 100 for b in out)


def test_hot_keys_are_spread(spark, as_rows):
    rows = spark.range(1000).selectExpr("case when id % 10 = 0 then null when id < 700 then 1 else id end as k", "id")
    table = spark.createDataFrame([(1, "hot"), (701, "one"), (5, "none")], "k long, name string")
    got = attached(rows, table, "k", "id", most=50)
    assert got.count() == 1000 and got.filter("name = 'hot'").count() == 630 and got.filter("name = 'one'").count() == 1
    cells = even_cells(spark.range(1000).selectExpr("id as a", "id as b", "0L as cell"), "cell", ["a", "b"], most=100)
    sizes = [r["count"] for r in cells.groupBy("cell", "part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 160
