"""Queries of this package against their SQL on the smallest tables."""

import pytest

from radiolake.llm import problems
from tests.oracle import DATA, same

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(problems.SQL))
def test_sql(spark, name):
    same(spark, problems.QUERIES[name], problems.SQL[name])


@pytest.mark.parametrize("name", sorted(set(problems.QUERIES) - set(problems.SQL)))
def test_runs(spark, name):
    assert problems.QUERIES[name](spark, str(DATA)).count() > 0


def test_every_document_has_its_row(spark):
    ids = problems.p8_ids(spark, str(DATA))
    assert ids.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert ids.columns == ["doc_id", "ids"]
