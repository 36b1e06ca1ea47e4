"""Named queries over a folder of order tables; `twins` holds the same queries in SQL.

Results carry plain types only (bigint, double rounded to six digits, string), so that both
engines' answers can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapsewise.functions import checks, fixed
from lapsewise.functions.numeric import exact_quantiles
from lapsewise.operators import (
    cleaning, decisions, features, labels, metrics, models, neighbours, netting, orders, profile, rfm, segments,
    snapshots, splits,
)
from lapsewise.plans.handover import SALES_ORDER, Handover, narrow_sales
from lapsewise.session import materialise, part_of, shared_folder
from lapsewise.sources import decision_store, ingest, lot_store, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LINE_ID = ["customer_id", "stock_code", "invoice", "line", "part", "supplier"]
HOME = "NATION_1"


def plain(df: DataFrame) -> DataFrame:
    """Comparable types: integers as bigint, doubles rounded, dates as text."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + 0.0
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = F.to_date(c).cast("string")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def query(build: Callable[[Handover], DataFrame]) -> Callable:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(build(Handover(spark, folder)))

    QUERIES[build.__name__] = run
    return build


def _line_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "line": F.col("row_seq.l_linenumber"), "part": F.col("row_seq.l_partkey"), "supplier": F.col("row_seq.l_suppkey"),
    })


# Cleaning and profiling ------------------------------------------------------------------

@query
def invoice_type_counts(t):
    return profile.value_shares(cleaning.with_invoice_type(t.raw()), "invoice_type")


@query
def invoice_prefix_counts(t):
    return profile.value_shares(t.raw().withColumn("prefix", F.regexp_extract("invoice", "^[A-Za-z]*", 0)), "prefix")


@query
def stock_category_summary(t):
    return profile.category_summary(cleaning.with_code_category(t.raw()))


@query
def special_code_summary(t):
    return profile.special_codes(cleaning.with_code_category(t.raw()))


@query
def clean_transactions(t):
    return _line_columns(cleaning.with_revenue(t.lines())).select(
        *LINE_ID, "quantity", "price", "invoice_date", "revenue", "invoice_type", "stockcode_category"
    )


@query
def ingested_lines(t):
    """The lines arrive as CSV and Parquet files in three deliveries, and every ingest is run twice: each file counts once."""
    raw = materialise(t.raw(country=True))
    names = [F.col(n).cast(tables.RAW_SCHEMA[o].dataType).alias(o) for o, n in tables.RAW_NAMES.items()]
    place = f"{shared_folder(t.spark)}/inbox/{uuid4()}"
    table = ingest.LineTable(t.spark, f"{place}/table")
    third = F.pmod(F.xxhash64("invoice"), F.lit(3))

    def deliver(part: int, fmt: str) -> None:
        tables.write_table(raw.filter(third == part).select(*names), f"{place}/{fmt}/delivery-{part}", fmt)
        for _ in range(2):
            table.ingest({"shop": f"{place}/{fmt}"}, fmt)

    deliver(0, "csv")
    deliver(1, "csv")
    deliver(2, "parquet")
    cleaned = cleaning.with_revenue(cleaning.clean_lines(table.lines()))
    return cleaned.groupBy("customer_id", "stock_code", "invoice", "quantity", "price", "invoice_date", "invoice_type", "stockcode_category").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("revenue").alias("revenue"), F.min("description").alias("first_description")
    )


@query
def excluded_lines(t):
    return profile.exclusion_trail(cleaning.with_exclusion_reason(t.raw()))


@query
def anomaly_counts(t):
    raw = t.raw().withColumn("raw_stock_code", F.col("stock_code"))
    return profile.anomaly_counts(cleaning.with_code_category(cleaning.with_invoice_type(raw)))


@query
def table_profile(t):
    return profile.column_profile(t.raw(country=True), [
        "customer_id", "stock_code", "invoice", "quantity", "price", "invoice_date", "country", "source_sheet",
    ])


@query
def numeric_describe(t):
    return profile.describe_numeric(t.lines(), ["quantity", "price"])


@query
def missing_values(t):
    return profile.missing_values(t.labels())


@query
def country_shares(t):
    return profile.value_shares(t.lines(country=True), "country")


@query
def top_countries_and_other(t):
    return profile.top_with_other(t.lines(country=True), "country", 10)


@query
def documentation_checks(t):
    # Documented facts of the data to compare with.
    expected = {"customers": 1500, "countries": 25, "first_day": "1995-01-01", "home_share": 0.04}
    return profile.documentation_checks(t.raw(country=True), expected, HOME)


@query
def monthly_line_counts(t):
    return orders.monthly_rows(t.lines())


# Netting and RFM -------------------------------------------------------------------------

@query
def fifo_purchases(t):
    return _line_columns(t.purchases()).select(*LINE_ID, "quantity", "price", "remaining_quantity", "net_revenue")


@query
def price_matched_purchases(t):
    return _line_columns(t.purchases("price_compatible")).select(
        *LINE_ID, "quantity", "price", "remaining_quantity", "net_revenue"
    )


@query
def netting_effect(t):
    first = rfm.netting_effect(netting.net_oldest_first(t.lines())).withColumn("policy", F.lit("fifo"))
    second = rfm.netting_effect(netting.net_newest_at_price(t.lines())).withColumn("policy", F.lit("price_compatible"))
    return first.unionByName(second)


@query
def folded_purchases(t):
    """First in, first out as a caller's Python fold."""
    kept = netting.net_purchases(t.lines().select(*lot_store.COLUMNS), netting.OLDEST_FIRST)
    return _line_columns(kept).select(*LINE_ID, "quantity", "price", "remaining_quantity", "net_revenue")


@query
def netting_policy_comparison(t):
    return rfm.policy_summary(rfm.compare_policies(t.rfm(), t.rfm("price_compatible")))


@query
def netting_largest_differences(t):
    return rfm.largest_differences(rfm.compare_policies(t.rfm(), t.rfm("price_compatible")))


@query
def customers_without_purchase(t):
    """Customers of all sources whose purchases were all cancelled, or who only cancelled."""
    return rfm.without_purchase(t.lines(), t.purchases())


@query
def newest_customers_without_purchase(t):
    """Customers of the newest source whose purchases in it were all cancelled, or who only cancelled."""
    lines = materialise(t.lines())
    newest = lines.agg(F.max("source_sheet").alias("newest")).scalar()
    recent = lines.withColumn("_newest", newest).filter("source_sheet = _newest").drop("_newest")
    return rfm.without_purchase(recent, netting.net_purchases(recent))


@query
def self_cancelled_orders(t):
    return rfm.largest_line_verdict(t.lines())


@query
def top_quantity_customers(t):
    return rfm.top_quantity_customers(t.lines())


@query
def non_positive_customers(t):
    return rfm.non_positive_customers(t.lines())


@query
def rfm_table(t):
    return t.rfm()


@query
def rfm_summary(t):
    return rfm.rfm_summary(t.rfm())


@query
def representative_customers(t):
    return rfm.representative_customers(t.rfm())


@query
def rfm_log_shape(t):
    logged = profile.log_values(t.rfm_written(), rfm.RFM)
    rows = [profile.distribution_shape(logged, c).withColumn("column_name", F.lit(c)) for c in rfm.RFM]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def capped_log_rfm(t):
    return profile.capped(profile.log_values(t.rfm_written(), rfm.RFM), ["frequency", "monetary"])


# Orders, gaps, calendar ------------------------------------------------------------------

@query
def order_table(t):
    return t.orders()


@query
def purchase_days(t):
    return orders.purchase_days(t.purchases())


@query
def customer_types(t):
    return orders.customer_types(orders.order_profile(t.orders()))


@query
def customer_order_profile(t):
    return orders.order_profile(t.orders())


@query
def order_value_shape(t):
    return profile.distribution_shape(t.orders(), "order_value")


@query
def central_orders(t):
    return profile.central_rows(t.orders(), "order_value").select("customer_id", "invoice", "order_value")


@query
def pareto_curve(t):
    return orders.pareto_curve(t.rfm(), "monetary")


@query
def top_customer_share(t):
    return orders.top_share(orders.pareto_curve(t.rfm(), "monetary"), "monetary")


@query
def order_gaps(t):
    return orders.order_gaps(t.orders())


@query
def short_gap_summary(t):
    return orders.short_gaps(orders.order_gaps(t.orders()))


@query
def purchase_day_gaps(t):
    return orders.day_gaps(t.days())


@query
def gap_quantiles(t):
    return orders.gap_quantiles(orders.day_gaps(t.days()))


@query
def gap_ecdf(t):
    return orders.gap_distribution(orders.day_gaps(t.days()))


@query
def customer_gap_summary(t):
    return orders.customer_gaps(orders.day_gaps(t.days()))


@query
def cadence_groups(t):
    return orders.cadence_groups(orders.customer_gaps(orders.day_gaps(t.days())))


@query
def horizon_coverage(t):
    return orders.horizon_coverage(orders.day_gaps(t.days()), t.purchases())


@query
def monthly_activity(t):
    return orders.monthly_activity(t.orders())


@query
def month_of_year(t):
    return orders.month_of_year(t.orders())


@query
def follow_up_time(t):
    return orders.follow_up(t.orders(), t.purchases())


@query
def follow_up_summary(t):
    return orders.follow_up_summary(orders.follow_up(t.orders(), t.purchases()))


# Labels ----------------------------------------------------------------------------------

@query
def labels_90d(t):
    days = materialise(orders.purchase_days(t.purchases()))
    start, end = days.agg(F.min("purchase_day"), F.max("purchase_day")).first()
    dates = snapshots.month_starts(*snapshots.valid_range(start, end, fixed.HISTORY_DAYS, fixed.HORIZON_DAYS))
    return labels.snapshot_labels(days, dates, dataset_end=end)


def _all_horizons(t: Handover) -> DataFrame:
    return labels.snapshot_labels(
        t.days(), t.snapshots(horizon=max(fixed.HORIZONS)), fixed.HORIZONS, dataset_end=t.span()[1]
    )


def _all_histories(t: Handover) -> DataFrame:
    return labels.snapshot_labels(
        t.days(), t.snapshots(history=max(fixed.HISTORY_WINDOWS)), history_days=fixed.HISTORY_WINDOWS,
        dataset_end=t.span()[1],
    )


@query
def label_prevalence_wilson(t):
    return labels.prevalence(_all_horizons(t), ["horizon_days"])


@query
def prevalence_by_snapshot(t):
    return labels.prevalence(_all_horizons(t), ["snapshot_date", "horizon_days"])


@query
def prevalence_by_stage(t):
    return labels.prevalence(t.labels(), ["customer_stage_at_snapshot"])


@query
def prevalence_matrix(t):
    return labels.prevalence_matrix(_all_horizons(t), fixed.HORIZONS)


@query
def recency_band_prevalence(t):
    return labels.recency_band_prevalence(_all_horizons(t))


@query
def label_checks(t):
    return labels.label_checks(t.labels(), t.span()[1])


@query
def horizon_checks(t):
    return labels.horizon_checks(_all_horizons(t))


@query
def history_window_by_snapshot(t):
    return labels.history_by_snapshot(_all_histories(t))


@query
def history_window_sensitivity(t):
    return labels.history_summary(_all_histories(t))


@query
def added_population(t):
    return labels.added_population(_all_histories(t))


@query
def added_population_summary(t):
    return labels.added_population_summary(labels.added_population(_all_histories(t)))


@query
def history_windows_nested(t):
    return labels.windows_nested(_all_histories(t))


# As-of state and features ----------------------------------------------------------------

@query
def asof_open_lots(t):
    lots = netting.open_lots(t.sales(), t.snapshots(), SALES_ORDER, lots=t.lots())
    return lots.groupBy("snapshot_date", "customer_id", "stock_code").agg(
        F.count(F.lit(1)).alias("lots"), F.sum("remaining_quantity").alias("units"), F.sum("net_revenue").alias("value")
    )


def _lot_store(t: Handover) -> lot_store.LotStore:
    return lot_store.LotStore(t.spark, f"{shared_folder(t.spark)}/lots/{uuid4()}")


@query
def incremental_lots(t):
    """The lines arrive in three lots, every 97th only with the last: the state equals that of the whole."""
    lines = materialise(t.lines().select(*lot_store.COLUMNS))
    first, last = lines.agg(F.min("invoice_date"), F.max("invoice_date")).first()
    at = [first + (last - first) * share for share in (0.6, 0.9)]
    late = F.pmod(F.xxhash64("row_seq"), F.lit(97)) == 0
    store = _lot_store(t)
    store.append(part_of(lines, lines.filter((F.col("invoice_date") < at[0]) & ~late)))
    store.append(part_of(lines, lines.filter((F.col("invoice_date") >= at[0]) & (F.col("invoice_date") < at[1]) & ~late)))
    store.append(part_of(lines, lines.filter((F.col("invoice_date") >= at[1]) | late)))
    return store.lifetimes().groupBy("customer_id", "stock_code", "invoice", "open_day", "price", "close_day").agg(F.sum("units").alias("units"))


def _from_scratch(t: Handover):
    """Lines, sale lifetimes, purchase days and snapshot dates, written by the query itself."""
    lines = materialise(narrow_sales(t.lines()))
    lots = materialise(netting.lot_lifetimes(lines, SALES_ORDER))
    days = materialise(orders.purchase_days_of_lots(lots))
    start, end = days.agg(F.min("purchase_day"), F.max("purchase_day")).first()
    dates = snapshots.month_starts(*snapshots.valid_range(start, end, fixed.HISTORY_DAYS, fixed.HORIZON_DAYS))
    return lines, lots, days, dates, end


@query
def snapshot_features(t):
    lines, lots, _, dates, _ = _from_scratch(t)
    return features.snapshot_features(lines, dates, lots=lots)


@query
def training_table(t):
    lines, lots, days, dates, end = _from_scratch(t)
    found = labels.snapshot_labels(days, dates, dataset_end=end)
    return features.training_table(lines, found, lots=lots, snapshots=dates, check=False)


@query
def training_contract_checks(t):
    rules = checks.training_rules() | checks.window_rules(fixed.FEATURE_WINDOWS)
    return checks.violations(t.training(), rules)


@query
def churn_class_medians(t):
    return profile.group_medians(t.training(), ["churn"], ["recency", "orders_90d", "monetary_90d", "lifetime_orders"])


@query
def feature_missing_values(t):
    return profile.missing_values(t.training(), features.feature_columns())


@query
def invalid_feature_rows(t):
    rows = t.training().select("customer_id", "snapshot_date", *features.feature_columns())
    # Deliberate breaches where a rule of the data applies, so that the check finds something in sound rows.
    broken = rows.withColumns({
        "recency": F.when(F.col("orders_30d") >= 2, -F.col("recency")).otherwise(F.col("recency")),
        "snapshot_month": F.when(F.col("orders_90d") >= 3, 13).otherwise(F.col("snapshot_month")),
        "average_order_value": F.when(F.col("lifetime_orders") > 1, F.col("average_order_value")),
    })
    return checks.split_valid(broken, features.feature_columns()).select(
        "customer_id", "snapshot_date", F.array_join("problems", "; ").alias("problems")
    ).filter("problems <> ''")


# Splits and metrics ----------------------------------------------------------------------

def _validation_dates(t: Handover) -> list:
    return t.snapshots()[-8:-4]


def _folds(t: Handover) -> DataFrame:
    return splits.rolling_folds(t.scored(), _validation_dates(t))


@query
def temporal_folds(t):
    return splits.split_summary(_folds(t), ["fold", "validation_date", "role"])


@query
def holdout_roles(t):
    return splits.split_summary(splits.temporal_holdout(t.scored(), t.snapshots()[-1]), ["role"])


@query
def recency_rule_metrics(t):
    rows = _folds(t).filter("role = 'validation'").withColumn("predicted", metrics.recency_rule(F.col("recency"), 60))
    return metrics.evaluate(rows, "predicted", "recency", ["fold"])


@query
def recency_confusion(t):
    rows = t.holdout().withColumn("predicted", metrics.recency_rule(F.col("recency"), 60))
    return metrics.confusion_matrix(rows, "predicted")


@query
def recency_threshold_tuning(t):
    return metrics.tune_recency(_folds(t), [30, 60, 90, 120, 150])


@query
def recency_tuning_by_fold(t):
    return metrics.recency_by_fold(_folds(t), [30, 60, 90, 120, 150]).drop("predicted_share")


@query
def chosen_recency_threshold(t):
    chosen = metrics.choose_recency(_folds(t), [30, 60, 90, 120, 150])
    return t.spark.createDataFrame([(chosen,)], "threshold int")


@query
def probability_threshold_tuning(t):
    rows = _folds(t).filter("role = 'validation'")
    return metrics.tune_probability(rows, score="churn_probability", tie=("customer_id", "fold"))


@query
def capacity_table(t):
    return metrics.capacity_table(t.scored(), "churn_probability", by=["snapshot_date"])


@query
def lift_at_20(t):
    return metrics.lift_at(t.scored(), "churn_probability", 0.20, ["snapshot_date"])


@query
def probability_errors(t):
    return metrics.probability_errors(t.scored(), "churn_probability", ["snapshot_date"])


@query
def calibration_curve(t):
    return metrics.calibration(t.scored(), "churn_probability")


@query
def model_comparison(t):
    """The recency score next to a value score, judged side by side on the last snapshot."""
    rows = t.holdout().withColumn("value_score", 1 / (1 + F.col("customer_value") / 100000.0))
    parts = []
    for name, score in (("recency", "churn_probability"), ("value", "value_score")):
        flagged = rows.withColumn("predicted", (F.col(score) >= 0.5).cast("int"))
        parts.append(metrics.evaluate(flagged, "predicted", score, probabilities=True).withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query
def segment_label_agreement(t):
    rows = segments.rule_segments(t.rfm_written()).withColumn(
        "band", F.when(F.col("recency") <= 200, "recent").otherwise("old")
    )
    return metrics.adjusted_rand(rows, "segment", "band")


# Decisions -------------------------------------------------------------------------------

@query
def risk_bands(t):
    validation = t.scored().filter(F.col("snapshot_date") == F.lit(_validation_dates(t)[-1]))
    cutoffs = decisions.risk_cutoffs(validation, "churn_probability")
    banded = decisions.assign_risk_bands(t.holdout(), "churn_probability", cutoffs)
    return banded.select("customer_id", "churn_probability", "risk_band", "risk_band_order")


@query
def priority_bands(t):
    ranked = decisions.campaign_priorities(t.scored(), "churn_probability", ["snapshot_date"])
    return ranked.select(
        "customer_id", "snapshot_date", "churn_probability", "probability_rank", "campaign_priority_band",
        "campaign_recommended_action",
    )


@query
def value_at_risk(t):
    return decisions.value_at_risk(t.scored(), by=["snapshot_date"]).select(
        "customer_id", "snapshot_date", "customer_value_cap", "value_at_risk_score", "probability_rank",
        "value_at_risk_rank", "value_protection_priority_band",
    )


def _ranked_holdout(t: Handover) -> DataFrame:
    """The last snapshot ranked by lifetime value, with the value cap of the latest safe development snapshot."""
    value = t.training().select("customer_id", "snapshot_date", F.col("lifetime_monetary").alias("customer_value"))
    scored = t.scored().drop("customer_value").join(value, ["customer_id", "snapshot_date"])
    split = splits.temporal_holdout(scored, t.snapshots()[-1], check=False).filter("role = 'development'")
    last = split.agg(F.max("snapshot_date").alias("d")).scalar()
    latest = split.withColumn("_last", last).filter(F.col("snapshot_date") == F.col("_last"))
    cap = exact_quantiles(latest, "customer_value", {"cap": 0.99}).first().cap
    holdout = scored.filter(F.col("snapshot_date") == F.lit(t.snapshots()[-1]))
    return decisions.value_at_risk(holdout, value_cap=cap)


@query
def strategy_comparison(t):
    return decisions.strategy_comparison(_ranked_holdout(t))


@query
def strategy_overlap(t):
    return decisions.strategy_overlap(_ranked_holdout(t))


@query
def band_profile(t):
    ranked = decisions.campaign_priorities(t.holdout(), "churn_probability")
    return decisions.band_profile(ranked, "campaign_priority_band", "churn_probability")


@query
def decision_table(t):
    return t.decisions()


@query
def decision_listing(t):
    return decision_store.list_decisions(
        t.decisions(), campaign_priority_band="Priority 3 - Nurture", order_by="value_at_risk", limit=50
    )


@query
def strategy_view(t):
    return decision_store.strategy_view(t.decisions(), "value_protection").select(
        "customer_id", "active_strategy", "active_priority_band", "active_recommended_action"
    )


@query
def refreshed_decisions(t):
    old = t.decisions().withColumn("risk_band", F.lit("Low")).withColumn("probability_rank", F.lit(0))
    return decisions.refresh_decisions(old, threshold=0.5)


@query
def upgraded_decisions(t):
    old = t.decisions().select(
        "customer_id", "snapshot_date", "churn_probability", F.col("campaign_priority_band").alias("risk_band"),
        F.col("above_model_threshold").alias("predicted_churn"),
        F.col("campaign_recommended_action").alias("recommended_action"),
    )
    return decision_store.upgrade_decisions(old)


def _store(t: Handover) -> decision_store.DecisionStore:
    return decision_store.DecisionStore(t.spark, f"{shared_folder(t.spark)}/decision-store-{uuid4()}")


@query
def published_decisions(t):
    """Publish twice, then read the snapshot back: the second run replaces the first."""
    store = _store(t)
    table = materialise(t.decisions())
    store.publish(table.withColumn("churn_probability", F.lit(0.0)))
    store.publish(table)
    return store.snapshot().drop("run_id", "scored_at")


@query
def published_customer(t):
    store = _store(t)
    table = materialise(t.decisions())
    store.publish(table)
    wanted = table.agg(F.max("customer_id")).first()[0]
    return store.customer(wanted, "value_protection").drop("run_id", "scored_at")


# Segmentation ----------------------------------------------------------------------------

@query
def scaled_rfm(t):
    return segments.scale(t.rfm())


@query
def dbscan_noise(t):
    return neighbours.dbscan_noise(segments.scale(t.rfm_written()), 0.40, fixed.MIN_SAMPLES, rfm.RFM).select(
        "customer_id", "core", "noise"
    )


@query
def robust_outliers(t):
    return neighbours.robust_outliers(segments.scale(t.rfm_written()), fixed.OUTLIER_EPS, fixed.MIN_SAMPLES, rfm.RFM)


@query
def dbscan_cluster_summary(t):
    scaled = segments.scale(t.rfm_written())
    rows = None
    for eps in fixed.OUTLIER_EPS:
        clusters = neighbours.dbscan_clusters(scaled, eps, fixed.MIN_SAMPLES, rfm.RFM)
        row = neighbours.cluster_summary(clusters).withColumn("eps", F.lit(eps))
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query
def k_distance(t):
    """Sorted distances to the tenth neighbour: the curve from which eps is chosen."""
    distances = neighbours.kth_neighbour_distance(segments.scale(t.rfm_written()), fixed.MIN_SAMPLES, rfm.RFM)
    return metrics.ranked(distances.withColumn("_low_first", -F.col("distance")), "_low_first").select(
        "customer_id", "distance", F.col("rank").alias("position")
    )


@query
def segment_context(t):
    return t.context()


@query
def segment_stats(t):
    return segments.segment_stats(t.context(), HOME)


@query
def segment_foreign_countries(t):
    return segments.top_foreign_countries(t.context(), HOME)


@query
def years_active_crosstab(t):
    return segments.activity_crosstab(t.context())


@query
def lifecycle_split(t):
    return segments.lifecycle_split(t.context(), fixed.SEGMENT_RECENT)


@query
def kmeans_segments(t):
    return segments.segment_table(t.rfm_written(), rfm.day_after_last(t.lines()))


def _points(t: Handover) -> DataFrame:
    return materialise(segments.scale(t.rfm_written()).select("customer_id", *rfm.RFM))


@query
def kmeans_elbow(t):
    return segments.elbow(_points(t), range(2, 11))


@query
def kmeans_silhouette(t):
    """Over plain distances, for the same fits."""
    return segments.silhouettes(_points(t), range(2, 11))


@query
def kmeans_stability(t):
    return segments.stability(_points(t), fixed.SEGMENT_COUNT)


@query
def rfm_plane(t):
    return segments.principal_plane(_points(t))[0]


@query
def rfm_plane_shares(t):
    return segments.principal_plane(_points(t))[1]


# Models ----------------------------------------------------------------------------------

def _model_folds(t: Handover) -> DataFrame:
    return splits.rolling_folds(t.training(), _validation_dates(t))


@query
def logistic_validation(t):
    data = t.training()
    return models.validate_logistic(_model_folds(t), models.feature_contract(data)).summary


@query
def logistic_scores(t):
    data = t.training()
    split = splits.temporal_holdout(data, t.snapshots()[-1])
    contract = models.feature_contract(data)
    model = models.fit_logistic(split.filter("role = 'development'"), contract, fixed.SELECTED_C)
    return models.predict(model, split.filter("role = 'test'")).select(
        "customer_id", "snapshot_date", "churn", "probability"
    )


@query
def logistic_coefficients(t):
    data = t.training()
    return models.coefficient_table(t.spark, models.fit_logistic(data, models.feature_contract(data), fixed.SELECTED_C))


@query
def tree_validation(t):
    data = t.training()
    return models.validate_trees(_model_folds(t), models.feature_contract(data), models.tree_candidates()).summary


@query
def tree_validation_folds(t):
    data = t.training()
    return models.validate_trees(_model_folds(t), models.feature_contract(data), models.tree_candidates()).per_fold


@query
def permutation_importance(t):
    data = t.training()
    split = splits.temporal_holdout(data, t.snapshots()[-1])
    contract = models.feature_contract(data)
    model = models.fit_logistic(split.filter("role = 'development'"), contract, fixed.SELECTED_C)
    return models.permutation_importance(model, split.filter("role = 'test'"), list(contract.numeric))


@query
def scored_decisions(t):
    """Train on every labelled snapshot, score the day after the data, decide."""
    bundle = models.package_model(t.training())
    day = t.sales().agg(F.date_add(F.to_date(F.max("invoice_date")), 1)).first()[0]
    latest = features.snapshot_features(t.sales(), [day], lots=t.lots()).drop("snapshot_quarter", "is_holiday_season")
    scores = bundle.score(latest, check=False)
    return decisions.decision_table(
        scores.select("customer_id", "snapshot_date", "churn_probability"), segments.rule_segments(t.rfm_written())
    )


@query
def batch_scores(t):
    """All prepared feature rows, of every snapshot, scored in one call."""
    bundle = models.package_model(t.training())
    return bundle.score_rows(t.training())


@query
def model_information(t):
    return models.package_model(t.training()).info(t.spark)
