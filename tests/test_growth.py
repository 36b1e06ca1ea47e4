"""What a task holds or moves must not grow faster than the input."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from lapsewise.functions import numeric
from lapsewise.operators import features, kmeans, labels, netting, orders, scans


def test_groups_are_counted_by_bucket_first(spark, blocks, monkeypatch):
    """A large table without a hot group moves no keys to find that out."""
    table = scans.written(spark.range(300).withColumn("k", F.col("id") % 100))
    made = []
    monkeypatch.setattr(scans, "materialise", lambda df: made.append(df) or df)
    with blocks(50):
        assert scans.hot_groups(table, ["k"]) is None
    assert not made
    with blocks(2):
        assert scans.hot_groups(table, ["k"]).count() == 100


def test_parts_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scans, "TASK_ROWS", 20)
    table = spark.range(1000).withColumn("k", F.col("id") % 100)
    seen = {}

    def run(scan):
        seen["parts"] = scan.df.rdd.getNumPartitions()
        return scan.add(place=scans.position()).df

    found = scans.ordered_scan(table, ["k"], ["id"], run)
    assert seen["parts"] == 50
    assert {r.id: r.place for r in found.collect()} == {i: i // 100 + 1 for i in range(1000)}


def dealt(df):
    """Into how many parts each shuffle of the plan deals its rows."""
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())]


def test_cancellations_are_summed_in_the_given_parts(spark, lines):
    rng = random.Random(3)
    table = lines([(rng.choice([None, *range(9)]), "A", f"i{i}", rng.choice([2.0, -1.0, -3.0]), rng.choice([None, 5.0]), f"2020-0{1 + rng.randrange(6)}-0{1 + rng.randrange(3)}") for i in range(400)])
    found = features._cancellation_features(table, [date(2020, 4, 1), date(2020, 7, 1)], 90, 37)
    assert set(dealt(found)) == {37}
    want = {}
    for r in table.collect():
        for i, t in enumerate((date(2020, 4, 1), date(2020, 7, 1))):
            if 0 < (t - r.invoice_date.date()).days <= 90:
                rows, cancelled, value, positive = want.get((r.customer_id, i), (0, 0.0, 0.0, 0.0))
                gone = max(-r.quantity, 0.0)
                want[r.customer_id, i] = (rows + (r.quantity < 0), cancelled + gone, value + gone * (r.price or 0.0), positive + max(r.quantity, 0.0))
    assert {(r[0], r[1]): tuple(r[-4:]) for r in found.select("customer_id", "_index", *found.columns[-4:]).collect()} == want


def test_purchase_days_follow_the_rows(spark, monkeypatch):
    lots = spark.range(1000).selectExpr(
        "if(id % 13 = 0, null, id % 40) customer_id", "concat('i', id % 300) invoice", "date_add(date'2020-01-01', cast(id % 100 as int)) open_day",
        "if(id % 7 = 0, date'2021-01-01', null) close_day", "cast(id % 5 + 1 as double) units", "2.0D price",
    )
    plain = orders.purchase_days_of_lots(lots)
    monkeypatch.setattr(scans, "TASK_ROWS", 20)
    found = orders.purchase_days_of_lots(scans.written(lots))
    assert set(dealt(found)) == {50} and set(dealt(plain)) != {50}
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))


def test_training_table_follows_the_rows(spark, lines, monkeypatch):
    """Every shuffle of the feature branches, their joins and the labels: rows repeat by snapshot behind it."""
    rng = random.Random(11)
    table = lines([(rng.randrange(30), rng.choice("ABC"), f"i{i // 2}", rng.choice([3.0, 2.0, -1.0]), 5.0, f"2020-{1 + rng.randrange(9):02d}-{1 + rng.randrange(28):02d}") for i in range(400)])
    dates = [date(2020, 7, 1), date(2020, 8, 1)]
    lots = scans.written(netting.lot_lifetimes(table))
    days = scans.written(orders.purchase_days_of_lots(lots))
    target = scans.written(labels.snapshot_labels(days, dates, dataset_end=date(2020, 12, 31)))

    def training():
        return features.training_table(table, target, lots=lots, snapshots=dates, check=False)

    plain = training().collect()
    monkeypatch.setattr(scans, "TASK_ROWS", 10, raising=False)
    parts, found = -(-2 * lots.count() // 10), training()
    assert dealt(found) and set(dealt(found)) <= {parts, parts + 1}
    assert plain and sorted(map(str, found.collect())) == sorted(map(str, plain))


def test_scan_writes_what_it_reads(spark, lines, monkeypatch):
    seen = []
    monkeypatch.setattr(netting, "ordered_scan", lambda df, *rest: seen.append(df.columns) or df)
    netting.lot_lifetimes(lines([(1, "A", "I", 1.0, 2.0, "2020-01-01")]).withColumn("description", F.lit("x")))
    assert "description" not in seen[0] and "row_seq" in seen[0]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_move_values_around_them_only(spark, blocks, monkeypatch, by):
    rng = random.Random(7)
    data = [("ab"[rng.random() < 0.3], rng.choice([None, 1.5, rng.gauss(0, 5), rng.randrange(4) * 1.0]), rng.random()) for _ in range(6000)]
    table = spark.createDataFrame([*data, ("c", None, None), ("d", 3.0, 4.0)], "g string, v double, w double")
    wanted = {"a": ("v", 0.5), "b": ("w", 0.5), "c": ("w", 0.99), "d": ("v", 0.0), "e": ("w", 1.0), "f": ("v", 0.25)}

    def found():
        return {tuple(r[c] for c in by): [None if r[n] is None else round(r[n], 12) for n in wanted] for r in numeric.quantile_table(table, wanted, by).collect()}

    expected, moved = found(), []
    plain = numeric.ordered_scan
    monkeypatch.setattr(numeric, "ordered_scan", lambda df, *rest: moved.append(df.agg(F.sum("_copies")).first()[0]) or plain(df, *rest))
    monkeypatch.setattr(numeric, "ACCURACY", 200)
    with blocks(1000):
        assert found() == expected
    assert moved[0] < 0.6 * len(wanted) * len(data)


def test_starts_equal_the_lowest_hashes(spark):
    import hashlib

    points = spark.range(3000).select(F.col("id").alias("customer_id"), (F.col("id") * 1.5).alias("x"))
    fits = [kmeans.Fit(s, r, 4) for s in (1, 42) for r in (0, 1)]
    found = kmeans.starts(points, "customer_id", ["x"], fits)
    for f in fits:
        order = sorted(range(3000), key=lambda i: hashlib.md5(f"{f.seed}:{f.restart}:{i}".encode()).hexdigest())
        assert found[f][:, 0].tolist() == [1.5 * i for i in order[:4]]


def test_row_fold_makes_no_frame_a_group(spark, lines):
    """Groups of a few rows that lie across batches, missing quantities included."""
    rng = random.Random(5)
    made = [(rng.choice([None, *range(40)]), f"i{rng.randrange(3)}", f"{i}", rng.choice([None, 1.0, 4.0, -2.0, -3.0]), 1.0, f"2020-01-{1 + rng.randrange(28):02d}") for i in range(600)]
    table = lines(made)
    want = {r.row_seq: r.remaining_quantity for r in netting.net_oldest_first(table).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = netting.net_by_fold(netting.OLDEST_FIRST, table)
        assert "InPandas" not in found._jdf.queryExecution().executedPlan().toString()
        got = {r.row_seq: r.remaining_quantity for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want
