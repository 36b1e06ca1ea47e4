import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapsewise.sources import ingest, tables
from lapsewise.sources.commits import CommitLog, Superseded
from lapsewise.sources.decision_store import DecisionStore
from tests.test_decisions import DAY, table  # noqa: F401

ROWS = [
    (f"{i}", f"8512{i % 10}A ", ' a "quoted", text ', float(i), dt.datetime(2010, 12, 1 + i % 28, 8, 26), 2.55, 17850.0 + i, "United Kingdom")
    for i in range(40)
]


def test_numbers_are_given_once(spark, tmp_path):
    log, other = CommitLog(spark, str(tmp_path / "log")), CommitLog(spark, str(tmp_path / "log"))
    assert log.last() == 0 and log.entries() == []
    assert log.append({"run": "a"}) == 1 and other.append({"run": "b"}) == 2
    with pytest.raises(Superseded):
        log.append({"run": "c"}, expected=1)
    assert log.append({"run": "ä"}, expected=2) == 3
    assert [(e["sequence"], e["run"]) for e in other.entries()] == [(1, "a"), (2, "b"), (3, "ä")]
    assert [e["run"] for e in log.entries(after=2)] == ["ä"]
    assert not [p for p in (tmp_path / "log").iterdir() if "draft" in p.name]


def test_the_last_commit_wins_whatever_the_clock(spark, table, tmp_path):  # noqa: F811
    first, second = (DecisionStore(spark, str(tmp_path / "store")) for _ in range(2))
    runs = [first.publish(table)]
    # The second writer's clock is a day ahead of the third's.
    append, ahead = second._log, dt.timedelta(days=1)
    second._log = lambda **row: append(**{k: v + ahead if k == "completed_at" else v for k, v in row.items()})
    runs += [second.publish(table), first.publish(table.filter("customer_id = '1'"))]
    for store in (first, second):
        assert {r.run_id for r in store.snapshot().collect()} == {runs[-1]}
        assert {r.run_id for r in store.snapshot(DAY).collect()} == {runs[-1]}


def test_interleaved_publications(spark, table, tmp_path):  # noqa: F811
    a, b = (DecisionStore(spark, str(tmp_path / "store")) for _ in range(2))
    a.publish(table)
    read = a.version()
    between = b.publish(table.filter("customer_id = '2'"))
    with pytest.raises(Superseded):
        a.publish(table.withColumn("segment", F.lit("older")), expected=read)
    assert [(r.customer_id, r.run_id) for r in a.snapshot().collect()] == [("2", between)]
    assert sorted(r.status for r in a.runs().collect()) == ["completed", "completed", "failed"]
    done = a.publish(table, expected=a.version())
    assert {r.run_id for r in b.snapshot().collect()} == {done}


def test_one_customer_reads_few_rows(spark, table, tmp_path):  # noqa: F811
    many = table.filter("customer_id = '1'").drop("customer_id").crossJoin(spark.range(40_000).select(F.col("id").cast("string").alias("customer_id")))
    store = DecisionStore(spark, str(tmp_path / "store"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as a large snapshot has
    try:
        store.publish(many)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = list((tmp_path / "store/customer_scores").rglob("*.parquet"))
    assert len(files) > 1
    found = store.snapshot().filter(F.col("customer_id") == "20011")
    plan = found._jdf.queryExecution().executedPlan()
    assert "EqualTo(customer_id,20011)" in plan.toString()
    assert len(found.collect()) == 1
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    found._jdf.collectAsList()
    assert leaves.head().metrics().apply("numOutputRows").value() <= 2 * 40_000 / len(files)
    gone = store.snapshot().filter(F.col("customer_id") == "20011x")
    assert gone._jdf.collectAsList().isEmpty()
    # The value lies inside a file's range; its bloom filter rules the row group out.
    assert gone._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value() == 0


def put(spark, folder, rows, fmt):
    tables.write_table(spark.createDataFrame(rows, tables.RAW_SCHEMA).repartition(2), str(folder), fmt)


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_each_file_once(spark, tmp_path, fmt):
    lines = ingest.LineTable(spark, str(tmp_path / "table"))
    assert lines.lines().count() == 0 and lines.lines().columns == [c.split()[0] for c in ingest.LINE_SCHEMA.split(", ")[:9]] + ["row_seq"]
    put(spark, tmp_path / "in/one", ROWS[:25], fmt)
    assert lines.ingest({"shop": str(tmp_path / "in")}, fmt) == 2 and lines.ingest({"shop": str(tmp_path / "in")}, fmt) == 0
    put(spark, tmp_path / "in/two", ROWS[25:], fmt)
    assert lines.ingest({"shop": str(tmp_path / "in")}, fmt) == 2 and lines.files().count() == 4
    found = sorted((r.invoice, r.stock_code, r.description, r.quantity, r.invoice_date, r.price, r.customer_id, r.country) for r in lines.lines().collect())
    assert found == sorted(ROWS)
    assert lines.lines().select("row_seq").distinct().count() == len(ROWS)


def test_changed_and_failed_files(spark, tmp_path):
    lines, folder = ingest.LineTable(spark, str(tmp_path / "table")), tmp_path / "in"
    put(spark, folder, ROWS[:10], "parquet")
    lines.ingest({"shop": str(folder)})
    broken = folder / "broken.parquet"
    broken.write_bytes(b"no table")
    with pytest.raises(Exception):
        lines.ingest({"shop": str(folder)})
    assert lines.lines().count() == 10 and len(list((tmp_path / "table/lines").iterdir())) == 1
    broken.unlink()
    assert lines.ingest({"shop": str(folder)}) == 0
    file = next(p for p in folder.iterdir() if p.suffix == ".parquet")
    file.write_bytes(file.read_bytes() + b" ")
    with pytest.raises(ValueError, match="changed"):
        lines.ingest({"shop": str(folder)})
    assert lines.ingest({}) == 0


def test_two_ingests_at_once(spark, tmp_path, monkeypatch):
    mine, other = (ingest.LineTable(spark, str(tmp_path / "table")) for _ in range(2))
    put(spark, tmp_path / "in/one", ROWS[:25], "parquet")
    append, met = mine.log.append, []

    def late(entry, expected=None):
        if not met:
            met.append(other.ingest({"shop": str(tmp_path / "in/one")}))
            put(spark, tmp_path / "in/two", ROWS[25:], "parquet")
        return append(entry, expected)

    monkeypatch.setattr(mine.log, "append", late)
    assert mine.ingest({"shop": str(tmp_path / "in")}) == 2 and met == [2]
    assert mine.lines().count() == len(ROWS) == other.lines().count()
    assert len(list((tmp_path / "table/lines").iterdir())) == 2
