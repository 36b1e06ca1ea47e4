"""The monthly batch jobs. Each reads tables, writes tables and can be rerun on its own.

    <root>/lines             cleaned lines                    build_history
    <root>/lots              sale lifetimes                   build_history
    <root>/purchase_days     one row per customer and day     build_history
    <root>/labels            by snapshot_date                 build_history
    <root>/training          by snapshot_date                 build_training
    <root>/segments          one row per customer             build_segments
    <root>/model             fitted model and contract        train_model
    <root>/decisions         latest decisions                 score_latest
    <root>/store             published decisions              score_latest, publish_file
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from lapsewise.functions import checks, fixed
from lapsewise.operators import decisions, features, labels, netting, orders, rfm, segments, snapshots
from lapsewise.operators.models import ModelBundle, package_model
from lapsewise.session import require_utc
from lapsewise.sources.decision_store import DecisionStore, upgrade_decisions
from lapsewise.sources.tables import read_table, write_table


def build_history(lines: DataFrame, root: str) -> DataFrame:
    """Net the lines once; write sale lifetimes, purchase days and 180/90-day monthly labels.

    `lines` is written first, so that neither the netting nor a later job repeats the
    work behind it; pass `read_table(spark, f"{root}/lines")` to the other jobs.
    """
    spark = lines.sparkSession
    require_utc(spark)
    write_table(lines, f"{root}/lines")
    lines = read_table(spark, f"{root}/lines")
    write_table(netting.lot_lifetimes(lines), f"{root}/lots")
    write_table(orders.purchase_days_of_lots(read_table(spark, f"{root}/lots")), f"{root}/purchase_days")
    days = read_table(spark, f"{root}/purchase_days")
    start, end = days.agg(F.min("purchase_day"), F.max("purchase_day")).first()
    dates = snapshots.month_starts(*snapshots.valid_range(start, end, fixed.HISTORY_DAYS, fixed.HORIZON_DAYS))
    found = labels.snapshot_labels(days, dates, dataset_end=end)
    write_table(found, f"{root}/labels", partition_by=["snapshot_date"])
    written = read_table(spark, f"{root}/labels")
    wrong = {k: v for k, v in labels.label_checks(written, end).first().asDict().items() if v}
    if wrong:
        raise ValueError(f"labels break their rules: {wrong}")
    return written


def build_training(lines: DataFrame, root: str, windows: Sequence[int] = fixed.FEATURE_WINDOWS) -> DataFrame:
    """Join labels with as-of features, check the contract, write the training table."""
    spark = lines.sparkSession
    require_utc(spark)
    target, lots = read_table(spark, f"{root}/labels"), read_table(spark, f"{root}/lots")
    dates = [r.snapshot_date for r in target.select("snapshot_date").distinct().collect()]
    table = features.training_table(lines, target, windows, lots=lots, snapshots=dates, check=False)
    checks.forbid_columns(table, fixed.FUTURE_COLUMNS, "training table")
    write_table(table, f"{root}/training", partition_by=["snapshot_date"])
    written = read_table(spark, f"{root}/training")
    checks.require_unique(written, ["customer_id", "snapshot_date"], "training table")
    # Written rows are a subset of the labels by the join, so equal counts mean full coverage.
    if written.count() != target.count():
        checks.require_covered(target, written, ["customer_id", "snapshot_date"], "labelled rows without features")
    checks.require_rules(written, checks.training_rules(max(windows)) | checks.window_rules(windows), "training table")
    return written


def build_segments(lines: DataFrame, root: str, **options) -> DataFrame:
    """Segment every customer on the net purchases up to the day after the last line."""
    spark = lines.sparkSession
    require_utc(spark)
    day = rfm.day_after_last(lines)
    table = segments.segment_table(rfm.rfm_table(netting.net_purchases(lines), day), F.to_date(day), **options)
    write_table(table, f"{root}/segments")
    return read_table(spark, f"{root}/segments")


def train_model(spark: SparkSession, root: str, c: float = fixed.SELECTED_C) -> ModelBundle:
    bundle = package_model(read_table(spark, f"{root}/training"), c)
    bundle.save(f"{root}/model")
    return bundle


def score_latest(lines: DataFrame, root: str) -> str:
    """Score the day after the last line, join segments of the same day, decide and publish; returns the run id."""
    spark = lines.sparkSession
    require_utc(spark)
    bundle = ModelBundle.load(f"{root}/model")
    day = lines.agg(F.date_add(F.to_date(F.max("invoice_date")), 1)).first()[0]
    table = read_table(spark, f"{root}/segments")
    days = [r.snapshot_date for r in table.select("snapshot_date").distinct().limit(2).collect()]
    if days != [day]:
        raise ValueError(f"segments are of {days}, scores of {day}: rebuild the segments first")
    lots = read_table(spark, f"{root}/lots")
    latest = features.snapshot_features(lines, [day], lots=lots).drop("snapshot_quarter", "is_holiday_season")
    scores = bundle.score(latest).select("customer_id", "snapshot_date", "churn_probability")
    # Incomplete rows are refused before anything is written.
    checks.require_covered(scores, table, ["customer_id"], "scored customers without a segment")
    decided = decisions.decision_table(
        scores, table, bundle.version, bundle.threshold, campaign_actions=bundle.campaign_actions, value_actions=bundle.value_actions
    )
    write_table(decided, f"{root}/decisions")
    decided = read_table(spark, f"{root}/decisions")
    return DecisionStore(spark, f"{root}/store").publish(decided)


def refresh_published(spark: SparkSession, root: str) -> str:
    """Recompute every derived column of the latest published snapshot from its probabilities and publish it.

    Refused when another run is published meanwhile, whose decisions would be replaced by older ones.
    """
    store = DecisionStore(spark, f"{root}/store")
    bundle, version = ModelBundle.load(f"{root}/model"), store.version()
    return store.publish(decisions.refresh_decisions(
        store.snapshot(), bundle.threshold, campaign_actions=bundle.campaign_actions, value_actions=bundle.value_actions
    ), version)


def publish_file(spark: SparkSession, root: str, path: str, schema=None, fmt: str | None = None) -> str:
    """Publish an existing decision file, of the current or the earlier layout."""
    return DecisionStore(spark, f"{root}/store").publish(upgrade_decisions(read_table(spark, path, schema, fmt)))
