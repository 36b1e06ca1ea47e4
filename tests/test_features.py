import datetime as dt
from collections import defaultdict
from statistics import median, pstdev

import pytest
from pyspark.sql import functions as F

from lapsewise.functions import checks, fixed
from lapsewise.operators import features
from replay import random_lines, remaining_before

T = dt.date(2021, 4, 1)
ROWS = [
    (1, "A", "I1", 10.0, 2.0, "2021-01-15"), (1, "A", "C1", -4.0, 2.0, "2021-03-01"), (1, "A", "C2", -6.0, 2.0, "2021-05-01"),
    (2, "B", "I2", 3.0, 5.0, "2021-02-01"), (2, "B", "I3", 2.0, 5.0, "2021-04-01"),
    (3, "C", "I4", 1.0, 10.0, "2020-09-01"),
    (4, "A", "I5", 2.0, 10.0, "2020-12-01"), (4, "B", "I6", 3.0, 10.0, "2021-03-01"),
]


def at(df):
    return {(r.customer_id, str(r.snapshot_date)): r for r in df.collect()}


def test_known_answers(lines):
    rows = at(features.snapshot_features(lines(ROWS), [T]))
    assert {c for c, _ in rows} == {1, 2, 4}
    one, two, four = (rows[c, "2021-04-01"] for c in (1, 2, 4))
    assert (one.lifetime_units, one.lifetime_monetary, one.monetary_90d) == (6.0, 12.0, 12.0)
    assert (one.cancellation_rows_180d, one.cancelled_units_180d, one.cancellation_unit_rate_180d) == (1, 4.0, 0.4)
    assert (two.lifetime_orders, two.lifetime_units, two.lifetime_monetary) == (1, 3.0, 15.0)
    assert (four.orders_90d, four.orders_previous_90d, four.orders_180d) == (1, 1, 2)
    assert (four.monetary_90d, four.monetary_previous_90d, four.monetary_change_90d) == (30.0, 20.0, 10.0)
    assert (four.median_purchase_gap, four.has_repeat_purchase_history, four.snapshot_month) == (90.0, 1, 4)
    assert (one.median_purchase_gap, one.has_repeat_purchase_history) == (None, 0)


def test_later_rows_never_matter(lines):
    snapshots = [dt.date(2021, 2, 1), T]
    rows = []
    for seed in range(4):
        rows += [(seed * 10 + r[0], *r[1:]) for r in random_lines(seed, rows=80, days=40)]
    rows = [(*r[:5], r[5].replace("2021-02", "2021-05")) for r in rows]
    full = {k: v for k, v in at(features.snapshot_features(lines(rows), snapshots)).items() if k[1] == "2021-04-01"}
    known = [r for r in rows if r[5] < "2021-04-01"]
    assert len(known) < len(rows)
    cut = {k: v for k, v in at(features.snapshot_features(lines(known), snapshots)).items() if k[1] == "2021-04-01"}
    assert full == cut and full


def expected_features(rows, cutoff: dt.date):
    """The main features from the replayed state, customer by customer."""
    state = remaining_before(rows, str(cutoff))
    lots = defaultdict(list)
    for i, units in state.items():
        day = dt.date.fromisoformat(rows[i][5][:10])
        lots[rows[i][0]].append(((cutoff - day).days, rows[i][2], rows[i][1], units, units * rows[i][4]))
    found = {}
    for customer, own in lots.items():
        if min(a for a, *_ in own) > 180:
            continue
        days = sorted({a for a, *_ in own}, reverse=True)
        gaps = [float(a - b) for a, b in zip(days, days[1:])]
        row = {
            "recency": days[-1], "tenure_days": days[0], "lifetime_purchase_days": len(days),
            "lifetime_orders": len({o for _, o, *_ in own}), "lifetime_unique_products": len({p for _, _, p, *_ in own}),
            "lifetime_units": sum(u for *_, u, _ in own), "lifetime_monetary": sum(v for *_, v in own),
            "median_purchase_gap": median(gaps) if gaps else None, "latest_purchase_gap": gaps[-1] if gaps else None,
            "purchase_gap_std": round(pstdev(gaps), 6) if gaps else None,
        }
        for w in fixed.FEATURE_WINDOWS:
            near = [x for x in own if x[0] <= w]
            row |= {
                f"purchase_days_{w}d": len({a for a, *_ in near}), f"orders_{w}d": len({o for _, o, *_ in near}),
                f"units_{w}d": sum(u for *_, u, _ in near), f"monetary_{w}d": sum(v for *_, v in near),
            }
        before = [x for x in own if 91 <= x[0] <= 180]
        row["orders_previous_90d"] = len({o for _, o, *_ in before})
        row["purchase_days_previous_90d"] = len({a for a, *_ in before})
        found[customer, str(cutoff)] = row
    return found


@pytest.mark.parametrize("hot", [False, True])
def test_features_against_replay(lines, blocks, hot):
    rows = []
    for seed in range(6):
        # Invoices that span days, days that close completely, customers that come back.
        rows += [(seed * 10 + r[0], *r[1:]) for r in random_lines(seed + 50, rows=70, customers=3, items=3)]
    months = {"2021-01": "2020-07", "2021-02": "2021-02"}
    rows = [(*r[:5], months[r[5][:7]] + r[5][7:]) for r in rows]
    dates = [dt.date(2020, 7, 10), dt.date(2020, 8, 1), dt.date(2020, 12, 1), dt.date(2021, 1, 10), dt.date(2021, 2, 8), dt.date(2021, 3, 1)]
    expected = {}
    for d in dates:
        expected |= expected_features(rows, d)
    if hot:
        with blocks(8):
            found = at(features.snapshot_features(lines(rows), dates))
    else:
        found = at(features.snapshot_features(lines(rows), dates))
    assert set(found) == set(expected)
    for key, row in expected.items():
        for name, value in row.items():
            mine = found[key][name]
            assert (round(mine, 6) if isinstance(mine, float) else mine) == value, (key, name)


def test_contract_and_errors(spark, lines):
    df = lines(ROWS)
    with pytest.raises(ValueError, match="90 and 180"):
        features.snapshot_features(df, [T], windows=(30, 60))
    with pytest.raises(ValueError, match="price"):
        features.snapshot_features(df.drop("price"), [T])
    names = features.feature_columns()
    assert len(names) == 41
    labels = spark.createDataFrame([(1, T, 0), (4, T, 1)], "customer_id bigint, snapshot_date date, churn int")
    table = features.training_table(df, labels)
    assert table.count() == 2
    checks.require_rules(table, checks.training_rules() | checks.window_rules(fixed.FEATURE_WINDOWS))
    with pytest.raises(ValueError, match="without features"):
        features.training_table(df, labels.union(spark.createDataFrame([(3, T, 1)], labels.schema)))
    with pytest.raises(ValueError, match="one row per"):
        features.training_table(df, labels.union(labels))


def test_valid_rows(spark, lines):
    rows = features.snapshot_features(lines(ROWS), [T]).drop("snapshot_quarter", "is_holiday_season")
    assert checks.split_valid(rows, features.feature_columns()).filter(F.size("problems") > 0).count() == 0
    bad = rows.withColumn("recency", -F.col("recency")).withColumn("snapshot_month", F.lit(13))
    assert checks.split_valid(bad, features.feature_columns()).first().problems == [
        "recency: negative", "snapshot_month: not a month",
    ]
    with pytest.raises(ValueError, match="unexpected"):
        checks.split_valid(rows.withColumn("extra", F.lit(1)), features.feature_columns())
