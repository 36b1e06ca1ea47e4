import pytest
from pyspark.sql import functions as F

from conftest import FOLDER
from lapsewise.operators.cleaning import clean_lines
from lapsewise.plans import jobs
from lapsewise.sources.decision_store import DecisionStore
from lapsewise.sources.retail import sales_lines
from lapsewise.sources.tables import read_table


def test_monthly_run(spark, tmp_path):
    root = str(tmp_path / "run")
    lines = clean_lines(sales_lines(spark, FOLDER, country=False))
    labels = jobs.build_history(lines, root)
    lines = read_table(spark, f"{root}/lines")
    training = jobs.build_training(lines, root)
    assert training.count() == labels.count() > 1000
    segments = jobs.build_segments(lines, root, restarts=1)
    assert segments.select("snapshot_date").distinct().count() == 1
    bundle = jobs.train_model(spark, root)
    assert len(bundle.contract.columns) == 41
    run = jobs.score_latest(lines, root)
    store = DecisionStore(spark, f"{root}/store")
    first = store.snapshot()
    assert {r.run_id for r in first.select("run_id").distinct().collect()} == {run}
    before = {r.customer_id: (r.probability_rank, r.value_at_risk_rank) for r in first.collect()}
    again = jobs.refresh_published(spark, root)
    rows = store.snapshot().collect()
    assert {r.run_id for r in rows} == {again}
    assert len(rows) == len(before) > 10
    assert sorted(r.value_at_risk_rank for r in rows) == list(range(1, len(rows) + 1))
    third = jobs.publish_file(spark, root, f"{root}/decisions")
    assert {r.customer_id: (r.probability_rank, r.value_at_risk_rank) for r in store.snapshot().collect()} == before
    assert store.runs().filter(F.col("run_id") == third).first().status == "completed"
    stale = segments.withColumn("snapshot_date", F.date_sub("snapshot_date", 1)).collect()
    spark.createDataFrame(stale, segments.schema).write.mode("overwrite").parquet(f"{root}/segments")
    with pytest.raises(ValueError, match="rebuild"):
        jobs.score_latest(lines, root)


def test_other_time_zones_are_refused(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            jobs.build_segments(spark.range(1), str(tmp_path))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
