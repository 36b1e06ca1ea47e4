from __future__ import annotations

import datetime as dt
import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lapsewise.session import GROUP_ROWS, local_session  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4, app="tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def blocks(spark):
    """Make every group of more than a few rows a hot one, so that the block path runs."""

    @contextmanager
    def forced(rows: int = 5):
        spark.conf.set(GROUP_ROWS, str(rows))
        try:
            yield
        finally:
            spark.conf.unset(GROUP_ROWS)

    return forced


LINES = (
    "customer_id bigint, stock_code string, invoice string, quantity double, price double, "
    "invoice_date timestamp, row_seq bigint"
)


def day(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


@pytest.fixture
def lines(spark):
    def make(rows):
        """rows: (customer, item, invoice, quantity, price, date)"""
        return spark.createDataFrame([(*r[:5], day(r[5]), i) for i, r in enumerate(rows)], LINES)

    return make
