import datetime as dt

import pytest

from lapsewise.operators import labels, orders, snapshots

D = dt.date
DAYS = [
    (1, D(2021, 3, 15), 50.0, 1), (1, D(2021, 4, 1), 75.0, 1), (2, D(2021, 2, 1), 60.0, 1),
    (3, D(2021, 1, 1), 40.0, 1), (4, D(2020, 12, 31), 30.0, 1), (5, D(2021, 3, 1), 80.0, 1),
    (5, D(2021, 6, 30), 90.0, 1), (99, D(2021, 3, 20), 10.0, 1), (99, D(2021, 7, 15), 10.0, 1),
]
SCHEMA = "customer_id bigint, purchase_day date, daily_value double, invoices bigint"
T = D(2021, 4, 1)


@pytest.fixture
def days(spark):
    return spark.createDataFrame(DAYS, SCHEMA)


def test_label_boundaries(days):
    rows = {r.customer_id: r for r in labels.snapshot_labels(days, [T], [90], 90).collect()}
    assert set(rows) == {1, 2, 3, 5, 99}
    one = rows[1]
    assert (one.history_purchase_days, one.next_purchase_date, one.days_to_next_purchase, one.churn) == (1, T, 0, 0)
    assert (rows[2].next_purchase_date, rows[2].churn) == (None, 1)
    assert rows[3].recency_at_snapshot == 90
    assert (rows[5].label_end_date, rows[5].returned_within_horizon, rows[5].churn) == (D(2021, 6, 30), 0, 1)
    assert one.history_monetary == 50.0 and one.observation_start == D(2021, 1, 1)
    assert one.customer_stage_at_snapshot == "One purchase day"


def test_label_errors(days):
    with pytest.raises(ValueError, match="outcome window"):
        labels.snapshot_labels(days, [D(2021, 6, 1)], [90])
    with pytest.raises(ValueError, match="daily_value"):
        labels.snapshot_labels(days.drop("daily_value"), [T])
    for bad in ({"horizons": [0]}, {"history_days": -1}, {"horizons": []}):
        with pytest.raises(ValueError):
            labels.snapshot_labels(days, [T], **bad)


def test_month_starts(spark):
    days = spark.createDataFrame([(1, D(2021, 1, 1), 1.0, 1), (1, D(2021, 12, 31), 1.0, 1)], SCHEMA)
    found = snapshots.monthly_snapshots(days, 90, 90)
    assert found == [D(2021, m, 1) for m in range(4, 11)]
    with pytest.raises(ValueError, match="cover"):
        snapshots.monthly_snapshots(days, 300, 90)


def test_several_horizons_and_histories(days):
    many = labels.snapshot_labels(days, [T], [30, 60, 90], 90)
    assert many.count() == 15
    assert labels.horizon_checks(many).first().asDict() == {"population_changes": 0, "rate_rises": 0}
    wide = labels.snapshot_labels(days, [T], [90], (30, 90, 180))
    sizes = {r.history_window_days: r["count"] for r in wide.groupBy("history_window_days").count().collect()}
    assert sizes == {30: 2, 90: 5, 180: 6}
    assert labels.windows_nested(wide, (30, 90, 180)).first()[0] == 0
    alone = labels.snapshot_labels(days, [T], [90], 90).drop("history_window_days")
    same = wide.filter("history_window_days = 90").drop("history_window_days")
    assert sorted(map(str, alone.collect())) == sorted(map(str, same.collect()))


def test_labels_reuse_one_customer_shuffle(days):
    found = labels.snapshot_labels(days, [T], [90], 90, dataset_end=D(2021, 7, 15))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_gaps(days):
    gaps = orders.day_gaps(days)
    assert {(r.customer_id, r.gap_days) for r in gaps.collect()} == {(1, 17), (5, 121), (99, 117)}
    cadence = {r.cadence: r.customers for r in orders.cadence_groups(orders.customer_gaps(gaps)).collect()}
    assert cadence == {"Within 30 days": 1, "91–180 days": 2}
