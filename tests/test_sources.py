import datetime as dt
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from lapsewise.session import materialise, scratch, written
from lapsewise.sources import tables
from lapsewise.sources.tables import read_table, write_table

ROWS = [
    ("536365", "85123A", "HOLDER", 6.0, dt.datetime(2010, 12, 1, 8, 26), 2.55, 17850.0, "United Kingdom"),
    ("C536379", "D", None, -1.0, dt.datetime(2010, 12, 1, 9, 41), 27.5, None, "United Kingdom"),
]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_two_sources(spark, tmp_path, fmt):
    raw = spark.createDataFrame(ROWS, tables.RAW_SCHEMA)
    paths = {name: str(tmp_path / f"{name}.{fmt}") for name in ("first", "second")}
    for path in paths.values():
        tables.write_table(raw.coalesce(1), path, fmt)
    lines = tables.load_sales_lines(spark, paths, fmt)
    rows = lines.collect()
    assert len(rows) == 4 and {r.source_sheet for r in rows} == {"first", "second"}
    assert len({r.row_seq for r in rows}) == 4
    first = [r for r in rows if r.invoice == "536365"][0]
    assert (first.stock_code, first.quantity, first.price, first.customer_id) == ("85123A", 6.0, 2.55, 17850.0)
    assert first.invoice_date == dt.datetime(2010, 12, 1, 8, 26)


def test_reading_rules(spark, tmp_path):
    with pytest.raises(ValueError, match="schema"):
        tables.read_table(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError, match="format"):
        tables.read_table(spark, "x", fmt="xlsx")
    df = spark.range(5).withColumnRenamed("id", "a")
    tables.write_table(df, str(tmp_path / "t.parquet"))
    assert tables.read_table(spark, str(tmp_path / "t.parquet")).count() == 5


def test_a_table_may_be_computed_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    write_table(spark.range(5), path)
    write_table(read_table(spark, path).filter("id > 1"), path)
    assert sorted(r.id for r in read_table(spark, path).collect()) == [2, 3, 4]
    with pytest.raises(Exception, match="lost"):
        write_table(spark.range(3).select(F.raise_error(F.lit("lost")).cast("bigint").alias("id")), path)
    assert read_table(spark, path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_scratch_tables_go(spark):
    with scratch(spark):
        table = materialise(spark.range(3))
        place = Path(table._written_at)
        assert table.count() == 3 and place.exists() and written(table) is table
    assert not place.exists()
