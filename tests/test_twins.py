"""Every query with an SQL twin gives the same values as the twin."""

import pytest

from conftest import FOLDER
from lapsewise.plans.catalog import QUERIES
from lapsewise.plans.twins import TWINS
from twin_check import compare, database

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", [q for q in QUERIES if q in TWINS])
def test_query_equals_twin(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, TWINS[name]) is None


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_hot_groups_change_no_result(spark, con, blocks):
    """The block path over the whole folder: netting, ranks and gaps equal their twins."""
    with blocks(40):
        for name in ("fifo_purchases", "price_matched_purchases", "order_gaps", "pareto_curve", "value_at_risk"):
            assert compare(QUERIES[name](spark, FOLDER), con, TWINS[name]) is None, name
