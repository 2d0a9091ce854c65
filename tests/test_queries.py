"""Core queries against their SQL on the smallest tables, and the driver's entry points."""

import pytest

import __spark_entry__
from radiolake.plans import detail_queries, general_problems, ingest_queries, reference_queries
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")
CORE = [general_problems, reference_queries, ingest_queries, detail_queries]
QUERIES = {n: f for m in CORE for n, f in m.QUERIES.items()}
SQL = {n: s for m in CORE for n, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["q01_device_totals", "p6_found", "p7_found"])
def test_scans_read_only_what_they_need(spark, name):
    plan = QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert "raw" not in plan.split("packets.parquet")[0].split("ReadSchema")[-1]
    schemas = [line for line in plan.splitlines() if "ReadSchema" in line and "packets.parquet" in line]
    assert schemas and all("raw:binary" not in s.split("ReadSchema")[1] for s in schemas)
