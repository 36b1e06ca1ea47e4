"""The growing open-lot state equals the replay of all lines."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lapsewise.operators import netting
from lapsewise.sources import lot_store
from lapsewise.sources.lot_store import LotStore


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    monkeypatch.setattr(lot_store, "PARTS", 4)


COLUMNS = ("customer_id", "stock_code", "invoice", "open_day", "price", "close_day", "units")


def rows_of(df):
    merged = df.groupBy(*COLUMNS[:-1]).agg(F.sum("units").alias("units"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in merged.collect()), key=str)


def random_lines(seed, n=260):
    r = random.Random(seed)
    out = []
    for i in range(n):
        day = dt.datetime(2020, 1, 1) + dt.timedelta(days=r.randrange(90), hours=r.choice((0, 0, 5)))
        quantity = float(r.choice((1, 2, 5, 9, -1, -2, -4, -30)))
        out.append((r.randrange(6), f"i{r.randrange(3)}", f"{'C' if quantity < 0 else ''}{i}", quantity, float(r.choice((2, 3))), day.isoformat(" ")))
    return out


@pytest.mark.parametrize("seed, late", [(1, 0.0), (2, 0.1), (3, 0.5)])
def test_state_equals_replay_after_every_append(spark, lines, tmp_path, seed, late):
    r = random.Random(seed)
    made = lines(random_lines(seed)).cache()
    when = {x.row_seq: 4 if r.random() < late else min(4, (x.invoice_date - dt.datetime(2020, 1, 1)).days // 20) for x in made.collect()}
    arrival = F.element_at(F.create_map(*[F.lit(v).cast("int") for pair in when.items() for v in pair]), F.col("row_seq").cast("int"))
    made = made.withColumn("arrival", arrival)
    store = LotStore(spark, str(tmp_path / "lots"))
    for step in range(5):
        store.append(made.filter(F.col("arrival") == step))
        whole = netting.lot_lifetimes(made.filter(F.col("arrival") <= step).drop("arrival"))
        assert rows_of(store.lifetimes()) == rows_of(whole), step
    day = dt.date(2020, 2, 15)
    got = {tuple(x) for x in store.as_of(day).collect()}
    want = netting.open_lots(made.drop("arrival"), [day]).drop("snapshot_date", "net_revenue")
    assert got == {tuple(x) for x in want.collect()}
    store.compact()
    assert rows_of(store.lifetimes()) == rows_of(whole)
    some = store.lifetimes().filter("close_day is null").first()
    store.append(lines([(some.customer_id, some.stock_code, "C9", -1.0, 2.0, "2020-06-01")]).withColumn("row_seq", F.lit(10_000).cast("bigint")))
    assert store.lifetimes().filter("close_day = '2020-06-01'").first().units == 1.0


def test_only_touched_groups_are_written(spark, lines, tmp_path):
    store = LotStore(spark, str(tmp_path / "lots"))
    store.append(lines([(c, "a", f"{c}", 5.0, 1.0, "2020-01-01") for c in range(50)]))
    store.append(lines([(7, "a", "C1", -2.0, 1.0, "2020-02-01"), (8, "a", "n", 1.0, 1.0, "2020-02-01")]).withColumn("row_seq", F.col("row_seq") + 100))
    second = spark.read.parquet(f"{store.root}/lots/generation=2")
    assert {(x.customer_id, x.units) for x in second.collect()} == {(7, 2.0), (7, 3.0), (8, 1.0)}
    assert spark.read.parquet(f"{store.root}/touched/generation=2").count() == 1
    # The plan reads the folders of the appended customers alone.
    plan = store.lifetimes([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "part" in plan


def test_failed_append_is_not_read(spark, lines, tmp_path):
    store = LotStore(spark, str(tmp_path / "lots"))
    with pytest.raises(ValueError):
        store.lifetimes()
    store.append(lines([(1, "a", "1", 5.0, 1.0, "2020-01-01")]))
    lines([(1, "a", "1", 99.0, 1.0, "2020-01-01")]).withColumn("part", F.lit(1)).write.parquet(f"{store.root}/lots/generation=2")
    assert store.lifetimes().count() == 1
    store.append(lines([]))
    store.append(lines([(1, "a", "C2", -1.0, 1.0, "2020-01-02")]).withColumn("row_seq", F.lit(9).cast("bigint")))
    assert {x.units for x in store.lifetimes().collect()} == {1.0, 4.0}
