import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapsewise.functions import fixed
from lapsewise.operators import decisions
from lapsewise.sources.decision_store import DecisionStore, list_decisions, upgrade_decisions

DAY = dt.date(2011, 12, 10)
SCHEMA = (
    "customer_id string, snapshot_date date, segment string, customer_value double, segment_frequency double, "
    "churn_probability double, above_model_threshold int, probability_threshold double, campaign_priority_band string, "
    "campaign_recommended_action string, customer_value_cap double, value_at_risk_score double, probability_rank int, "
    "value_at_risk_rank int, value_protection_priority_band string, value_protection_recommended_action string, "
    "model_version string"
)
ROWS = [
    ("1", DAY, "Champions", 1000.0, 10.0, 0.2, 0, 0.4, "Standard monitoring", "Monitor", 1000.0, 200.0, 2, 1,
     "Priority 1 - Immediate", "Call", "v1"),
    ("2", DAY, "Lapsed low-value", 100.0, 1.0, 0.9, 1, 0.4, "Priority 1 - Immediate", "Act", 1000.0, 90.0, 1, 2,
     "Standard monitoring", "Monitor", "v1"),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def scores(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "customer_id bigint, p double")


def test_cutoffs_and_bands(spark):
    cutoffs = decisions.risk_cutoffs(scores(spark, [.1, .2, .3, .4, .5]), "p")
    assert {k: round(v, 9) for k, v in cutoffs.items()} == {"Medium": 0.3, "High": 0.42, "Very High": 0.46}
    fixed_cutoffs = {"Medium": .3, "High": .6, "Very High": .8}
    banded = decisions.assign_risk_bands(scores(spark, [.1, .4, .7, .9]), "p", fixed_cutoffs)
    assert [r.risk_band for r in banded.orderBy("customer_id").collect()] == list(fixed.RISK_BANDS)
    with pytest.raises(ValueError):
        decisions.assign_risk_bands(scores(spark, [.1]), "p", {"Medium": .9, "High": .6, "Very High": .8})
    with pytest.raises(ValueError):
        decisions.assign_risk_bands(scores(spark, [.1]), "p", {"Medium": .9})


def test_priority_sizes(spark):
    found = decisions.campaign_priorities(scores(spark, [i / 10 for i in range(10)]), "p")
    sizes = {r.campaign_priority_band: r["count"] for r in found.groupBy("campaign_priority_band").count().collect()}
    assert sizes == {
        "Priority 1 - Immediate": 1, "Priority 2 - Targeted": 1, "Priority 3 - Nurture": 3, "Standard monitoring": 5,
    }


def test_value_at_risk(spark):
    df = spark.createDataFrame([(1, .9, 100.0), (2, .8, 200.0), (3, .2, 10000.0)], "customer_id bigint, churn_probability double, customer_value double")
    rows = {r.customer_id: r for r in decisions.value_at_risk(df, cap_quantile=.5, check=True).collect()}
    assert rows[1].customer_value_cap == 200.0
    assert [rows[i].value_at_risk_score for i in (1, 2, 3)] == [90.0, 160.0, 40.0]
    assert rows[2].value_at_risk_rank == 1 and rows[3].customer_value == 10000.0
    capped = decisions.value_at_risk(df.withColumn("churn_probability", F.lit(.5)), value_cap=200.0)
    assert {r.customer_id: r.value_at_risk_score for r in capped.collect()} == {1: 50.0, 2: 100.0, 3: 100.0}
    with pytest.raises(ValueError, match="probability"):
        decisions.value_at_risk(df.withColumn("churn_probability", F.lit(1.5)), check=True)
    with pytest.raises(ValueError):
        decisions.value_at_risk(df, value_cap=-1.0)


def test_missing_values_never_rank_high(spark):
    """A missing value or score is refused; unchecked, it has no score, no band and the last rank."""
    rows = [(1, .9, None), (2, .1, 100.0), (3, None, 5000.0)]
    df = spark.createDataFrame(rows, "customer_id bigint, churn_probability double, customer_value double")
    for bad in (df, df.filter("customer_id <> 3"), df.filter("customer_id <> 1")):
        with pytest.raises(ValueError, match="contract"):
            decisions.value_at_risk(bad)
    ranked = {r.customer_id: r for r in decisions.value_at_risk(df, value_cap=4900.0, check=False).collect()}
    assert ranked[1].value_at_risk_score is None and ranked[2].value_at_risk_rank == 1 and ranked[2].value_at_risk_score == 10.0
    cutoffs = {"Medium": .3, "High": .6, "Very High": .8}
    bands = {r.customer_id: r.risk_band for r in decisions.assign_risk_bands(df, "churn_probability", cutoffs).collect()}
    assert bands == {1: "Very High", 2: "Low", 3: None}
    scores = df.select("customer_id", F.current_date().alias("snapshot_date"), F.lit(.5).alias("churn_probability"))
    segments = spark.createDataFrame([(2, "s", 1, 10.0)], "customer_id bigint, segment string, frequency bigint, monetary double")
    with pytest.raises(ValueError, match="contract"):
        decisions.decision_table(scores, segments)


def test_publish_refuses_incomplete_decisions(spark, table, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    for column in ("segment", "customer_value", "churn_probability"):
        missing = F.when(F.col("customer_id") == "1", F.lit(None)).otherwise(F.col(column))
        with pytest.raises(ValueError, match="contract"):
            store.publish(table.withColumn(column, missing))
    assert store.latest_snapshot_date() is None


def test_listing(table):
    def ids(**options):
        return [r.customer_id for r in list_decisions(table, **options).collect()]

    assert ids() == ["2", "1"]
    assert ids(order_by="value_at_risk") == ["1", "2"]
    assert ids(campaign_priority_band="Standard monitoring") == ["1"]
    assert ids(segment="Lapsed low-value") == ["2"]
    for bad in ({"limit": 0}, {"limit": 101}, {"order_by": "name"}):
        with pytest.raises(ValueError):
            list_decisions(table, **bad)


def test_publish_replaces(spark, table, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    store.publish(table)
    assert store.snapshot().count() == 2 and store.latest_snapshot_date() == DAY
    run = store.publish(table.filter("customer_id = '1'"))
    assert [(r.customer_id, r.run_id) for r in store.snapshot().collect()] == [("1", run)]
    runs = store.runs().collect()
    assert sorted(r.row_count for r in runs) == [1, 2] and {r.status for r in runs} == {"completed"}
    assert store.customer("1", "value_protection").first().active_priority_band == "Priority 1 - Immediate"
    assert store.customer("2").count() == 0
    assert [r.customer_id for r in store.customers("value_protection").collect()] == ["1"]
    later = table.withColumn("snapshot_date", F.date_add("snapshot_date", 30))
    store.publish(later)
    assert store.latest_snapshot_date() == DAY + dt.timedelta(days=30)
    assert store.snapshot(DAY).count() == 1


def test_a_failed_run_stays_invisible(spark, table, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    store.publish(table)
    broken = table.withColumn("churn_probability", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        store.publish(broken)
    assert store.snapshot().count() == 2
    assert {r.status for r in store.runs().collect()} == {"completed", "failed"}


def test_publish_rules(spark, table, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    other = table.withColumn("snapshot_date", F.date_add("snapshot_date", F.col("customer_id").cast("int")))
    for bad, text in (
        (table.drop("segment"), "segment"), (table.filter("false"), "empty"), (other, "one snapshot"),
        (table.withColumn("model_version", F.col("customer_id")), "one model version"),
        (table.withColumn("customer_id", F.lit("1")), "one row per"),
    ):
        with pytest.raises(ValueError, match=text):
            store.publish(bad)


def test_upgrade(spark):
    old = spark.createDataFrame([("1", "High", 1, "Call")], "customer_id string, risk_band string, predicted_churn int, recommended_action string")
    row = upgrade_decisions(old).first()
    assert (row.campaign_priority_band, row.above_model_threshold, row.probability_threshold) == ("High", 1, 0.4)
    assert row.value_protection_priority_band == "Standard monitoring"


def test_refresh_keeps_scores_and_rebuilds_the_rest(table):
    stale = table.withColumn("risk_band", F.lit("x")).withColumn("campaign_priority_band", F.lit("wrong"))
    rows = {r.customer_id: r for r in decisions.refresh_decisions(stale, 0.1).collect()}
    assert (rows["2"].probability_rank, rows["1"].above_model_threshold, rows["1"].probability_threshold) == (1, 1, 0.1)
    assert rows["2"].campaign_priority_band == "Priority 3 - Nurture" and "risk_band" not in rows["1"]
