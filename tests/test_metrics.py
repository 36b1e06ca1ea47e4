import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lapsewise.functions.numeric import exact_quantiles
from lapsewise.operators import metrics, orders, profile, rfm, splits

SCORES = "customer_id bigint, churn int, score double"


def rows(spark, pairs):
    return spark.createDataFrame([(i, c, float(s)) for i, (c, s) in enumerate(pairs)], SCORES)


@pytest.fixture
def snapshots(spark):
    dates = [dt.date(2020, 10, 1), dt.date(2020, 11, 1), dt.date(2020, 12, 1), dt.date(2021, 1, 1), dt.date(2021, 2, 1),
             dt.date(2021, 3, 1), dt.date(2021, 6, 1), dt.date(2021, 7, 1), dt.date(2021, 8, 1), dt.date(2021, 9, 1)]
    churn = [0, 0, 1, 0, 1, 1, 0, 1, 0, 1]
    return spark.createDataFrame(
        [(i, d, 10.0 * (i + 1), c) for i, (d, c) in enumerate(zip(dates, churn))],
        "customer_id bigint, snapshot_date date, recency double, churn int",
    )


def test_rolling_folds_leave_a_gap(snapshots):
    folds = splits.rolling_folds(snapshots, [dt.date(2021, 3, 1)], 90)
    train = {str(r.snapshot_date) for r in folds.filter("role = 'train'").collect()}
    assert "2020-12-01" in train and "2021-01-01" not in train
    assert [str(r.snapshot_date) for r in folds.filter("role = 'validation'").collect()] == ["2021-03-01"]
    with pytest.raises(ValueError, match="no validation"):
        splits.rolling_folds(snapshots, [dt.date(2021, 4, 1)])
    with pytest.raises(ValueError, match="no training"):
        splits.rolling_folds(snapshots, [dt.date(2020, 11, 1)])


def test_holdout(snapshots):
    roles = {str(r.snapshot_date): r.role for r in splits.temporal_holdout(snapshots, dt.date(2021, 9, 1)).collect()}
    assert (roles["2021-06-01"], roles["2021-07-01"], roles["2021-08-01"], roles["2021-09-01"]) == (
        "development", "purged", "purged", "test")
    with pytest.raises(ValueError):
        splits.temporal_holdout(snapshots, dt.date(2021, 10, 1))


def test_recency_rule(spark):
    df = spark.createDataFrame([(29.0,), (30.0,), (31.0,)], "recency double")
    assert [r[0] for r in df.select(metrics.recency_rule(F.col("recency"), 30)).collect()] == [0, 1, 1]


def test_lift_and_perfect_scores(spark):
    df = rows(spark, [(0, .1), (0, .2), (1, .8), (1, .9)])
    assert metrics.lift_at(df, "score", 0.5).first().lift == 2.0
    flagged = df.withColumn("p", (F.col("score") >= 0.5).cast("int"))
    row = metrics.evaluate(flagged, "p", "score", probabilities=True).first()
    assert all(row[n] == 1.0 for n in ("precision", "recall", "f1", "balanced_accuracy", "roc_auc", "average_precision"))
    with pytest.raises(ValueError):
        metrics.lift_at(df, "score", 0.0)


def test_rank_metrics_against_pairs(spark, blocks):
    rng = random.Random(1)
    data = [(int(rng.random() < 0.4), rng.randint(0, 12) / 12) for _ in range(200)]
    pos = [s for c, s in data if c]
    neg = [s for c, s in data if not c]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, tp, seen = 0.0, 0, 0
    for s in sorted({s for _, s in data}, reverse=True):
        t = sum(1 for c, x in data if x == s and c)
        n = sum(1 for _, x in data if x == s)
        tp, seen = tp + t, seen + n
        ap += t / len(pos) * tp / seen
    df = rows(spark, data)
    plain = metrics.ranking(df, "score").first()
    assert plain.roc_auc == pytest.approx(auc) and plain.average_precision == pytest.approx(ap)
    with blocks(4):
        cut = metrics.ranking(df, "score").first()
    assert cut.roc_auc == pytest.approx(auc) and cut.average_precision == pytest.approx(ap)


def test_global_rank_in_blocks(spark, blocks):
    # A third of all rows share one score.
    data = [(i % 2, 1.0 if i % 3 == 0 else i / 300) for i in range(300)]
    df = rows(spark, data)
    expected = sorted(map(tuple, metrics.ranked(df, "score").collect()))
    with blocks(25):
        assert sorted(map(tuple, metrics.ranked(df, "score").collect())) == expected


def test_recency_tuning(spark):
    df = spark.createDataFrame(
        [(i, 1, "validation", c, r) for i, (c, r) in enumerate([(0, 10.0), (0, 40.0), (1, 80.0), (1, 120.0)])],
        "customer_id bigint, fold int, role string, churn int, recency double",
    )
    table = metrics.tune_recency(df, [30, 60, 90])
    assert metrics.best(table)["threshold"] == 60


def test_probability_tuning(spark):
    df = rows(spark, [(0, .1), (0, .2), (0, .4), (1, .6), (1, .8), (1, .9)])
    assert metrics.best(metrics.tune_probability(df, [.3, .5, .7], "score"))["threshold"] == 0.5
    with pytest.raises(ValueError):
        metrics.tune_probability(df, [0.5, 1.0], "score")


def test_capacity(spark):
    df = rows(spark, [(1, .9), (0, .8), (1, .7), (0, .2), (1, .1)])
    row = metrics.capacity_table(df, "score", [0.4]).first()
    assert (row.customers_contacted, row.churners_reached, row.precision) == (2, 1, 0.5)


def test_quantiles_both_ways(spark, blocks):
    rng = random.Random(2)
    data = [(rng.choice("ab"), rng.choice([None, 1.5, rng.random()])) for _ in range(301)]
    df = spark.createDataFrame(data, "g string, v double")
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}

    def found():
        return {r.g: [round(r[n], 12) for n in wanted] for r in exact_quantiles(df, "v", wanted, ["g"]).collect()}

    expected = found()
    with blocks(20):
        assert found() == expected
        whole = exact_quantiles(df, "v", {"m": 0.5}).first().m
    assert whole == pytest.approx(exact_quantiles(df, "v", {"m": 0.5}).first().m)


def test_skewness_and_pareto(spark, blocks):
    values = [1.0, 2.0, 2.0, 3.0, 14.0]
    df = spark.createDataFrame(list(enumerate(values)), "customer_id bigint, monetary double")
    n, mean = len(values), sum(values) / len(values)
    m2, m3 = (sum((v - mean) ** k for v in values) / n for k in (2, 3))
    expected = m3 / m2 ** 1.5 * (n * (n - 1)) ** 0.5 / (n - 2)
    assert profile.distribution_shape(df, "monetary").first().skewness == pytest.approx(expected)
    curve = orders.pareto_curve(df, "monetary")
    plain = sorted(map(tuple, curve.collect()))
    assert plain[-1][0] == 4 and orders.top_share(curve, "monetary", 0.4).first().top_value_share == pytest.approx(17 / 22)
    with blocks(2):
        cut = sorted(map(tuple, orders.pareto_curve(df, "monetary").collect()))
    assert [x[:3] for x in cut] == [x[:3] for x in plain]
    assert [x[4] for x in cut] == pytest.approx([x[4] for x in plain])


def test_rand_index(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) + 10) for i in range(30)], "a int, b int")
    assert metrics.adjusted_rand(same, "a", "b").first()[0] == 1.0
    mixed = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")
    assert metrics.adjusted_rand(mixed, "a", "b").first()[0] == pytest.approx(-0.5)


def test_missing_scores_are_left_out(spark):
    rows = spark.createDataFrame([(1, 1, .8), (2, 0, None), (3, 0, .4)], "customer_id bigint, churn int, p double")
    found, known = (metrics.probability_errors(r, "p").first() for r in (rows, rows.filter("p IS NOT NULL")))
    assert found == known
    capped = {r.customer_id: (r.p, r.p_capped) for r in profile.capped(rows, ["p"], 0.5).collect()}
    assert capped == {1: (pytest.approx(.6), 1), 2: (None, 0), 3: (.4, 0)}


def test_whole_days_count_fractions_of_seconds(spark):
    rows = spark.createDataFrame(
        [(1, "I", dt.datetime(2020, 1, 1, 10, 0, 0, 700000), 1.0)], "customer_id bigint, invoice string, invoice_date timestamp, net_revenue double"
    )
    for end, days in ((dt.datetime(2020, 1, 2, 10, 0, 0, 200000), 0), (dt.datetime(2020, 1, 2, 10, 0, 0, 700000), 1)):
        assert rfm.rfm_table(rows, end).first().recency == days
