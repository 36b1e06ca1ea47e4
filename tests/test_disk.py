"""What lies on disk at once must not be a multiple of what a step needs."""

import random
import re
import time
from datetime import date
from pathlib import Path

from pyspark.sql import functions as F

from lapsewise.operators import features, labels, netting, orders, scans
from lapsewise.plans.handover import Handover
from lapsewise.session import materialise, part_of

from conftest import FOLDER


def shuffled(spark):
    """Shuffle files that lie on disk."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {p.name for folder in folders for p in Path(folder.getPath()).glob("*/shuffle_*.data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffled(spark)
    table = materialise(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count().repartition(3, "count"))
    for _ in range(50):  # files are deleted beside the next step
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left and table.count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_narrowed_tables_are_not_written_again(spark, lines, monkeypatch):
    table = materialise(lines([(1, "A", "I", 2.0, 2.0, "2020-01-01"), (1, "A", "C", -1.0, 2.0, "2020-01-02"), (1, "A", "Z", 0.0, 2.0, "2020-01-02")]))
    made = []
    monkeypatch.setattr(scans, "materialise", lambda df: made.append(df) or materialise(df))
    monkeypatch.setattr("lapsewise.session.materialise", lambda df: made.append(df) or materialise(df))
    lots = netting.lot_lifetimes(table)
    kept = netting.net_newest_at_price(table)
    assert not made
    assert sorted((r.units, str(r.close_day)) for r in lots.collect()) == [(1.0, "2020-01-02"), (1.0, "None")]
    assert sorted(r.remaining_quantity for r in kept.collect()) == [0.0, 0.0, 1.0]
    assert not getattr(part_of(spark.range(3), spark.range(2)), "_written_at", None)


def test_repeated_rows_are_not_moved(spark, lines):
    """Lots, lines and labels move once each; snapshots repeat them behind that."""
    rng = random.Random(12)
    table = lines([(rng.randrange(30), rng.choice("ABC"), f"i{i // 2}", rng.choice([3.0, 2.0, -1.0]), 5.0, f"2020-{1 + rng.randrange(9):02d}-{1 + rng.randrange(28):02d}") for i in range(400)])
    dates = [date(2020, 7, 1), date(2020, 8, 1)]
    lots = materialise(netting.lot_lifetimes(table))
    days = materialise(orders.purchase_days_of_lots(lots))
    target = materialise(labels.snapshot_labels(days, dates, dataset_end=date(2020, 12, 31)))
    found = features.training_table(materialise(table), target, lots=lots, snapshots=dates, check=False)
    rows = found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    moved = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", line) and "Reused" not in line]
    assert len(moved) == 3, plan
    assert sorted((r.customer_id, r.snapshot_date, r.churn) for r in rows) == sorted((r.customer_id, r.snapshot_date, r.churn) for r in target.collect())


def test_labels_keep_their_rows(spark, lines):
    """Repeated, unknown and missing keys of the labels behave as in a join."""
    table = lines([(1, "A", "I1", 2.0, 3.0, "2020-03-01"), (2, "A", "I2", 1.0, 3.0, "2020-03-02"), (None, "A", "I3", 1.0, 3.0, "2020-03-02")])
    day = date(2020, 4, 1)
    target = spark.createDataFrame([(1, day, 1), (1, day, 0), (1, day, None), (9, day, 1), (None, day, 1)], "customer_id bigint, snapshot_date date, churn int")
    rows = features.training_table(table, target, snapshots=[day], check=False).collect()
    assert sorted((r.customer_id, r.churn is None, r.churn or 0, r.lifetime_units) for r in rows) == [(1, False, 0, 2.0), (1, False, 1, 2.0), (1, True, 0, 2.0)]


def test_open_lots_of_written_lifetimes(spark, lines, blocks):
    rng = random.Random(4)
    table = lines([(rng.randrange(4), rng.choice("AB"), f"i{i // 2}", rng.choice([3.0, 2.0, -1.0]), 5.0, f"2020-{1 + rng.randrange(5):02d}-{1 + rng.randrange(28):02d}") for i in range(200)])
    dates = [date(2020, 3, 1), date(2020, 5, 1)]
    want = sorted(map(str, netting.open_lots(table, dates).collect()))
    lots = netting.lot_lifetimes(table)
    assert sorted(map(str, netting.open_lots(table, dates, lots=lots).collect())) == want
    with blocks():
        assert sorted(map(str, netting.open_lots(table, dates, lots=lots).collect())) == want


def test_the_sessions_lines_have_the_order_of_the_adapter(spark):
    from lapsewise.plans.handover import SALES_ORDER

    t = Handover(spark, FOLDER)
    plain = netting.lot_lifetimes(t.lines()).collect()
    assert sorted(map(str, netting.lot_lifetimes(t.sales(), SALES_ORDER).collect())) == sorted(map(str, plain))
