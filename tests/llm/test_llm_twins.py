"""Every text-preparation query with an SQL twin gives the same values as the twin."""

import pytest

import __spark_entry__ as driver
import corpus_pipeline
FOLDER = "/root/testdata/sf0.001"
from lapsewise.llm.queries import QUERIES, TWINS
from twin_check import compare, database


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", list(TWINS))
def test_query_equals_twin(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, TWINS[name]) is None


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(driver.queries()) and set(TWINS) <= set(driver.oracle_sql())
    assert [f"op{n}_" for n in range(1, 14)] == [q[: q.index("_") + 1] for q in QUERIES]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
