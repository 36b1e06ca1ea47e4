"""Inactivity labels at historical snapshots, for all snapshots in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapsewise.functions import fixed
from lapsewise.functions.checks import require_columns, require_positive
from lapsewise.functions.numeric import bin_order, binned, count_if, exact_quantiles, quantile_table, wilson
from lapsewise.operators.orders import DAY_COLUMNS
from lapsewise.operators import scans
from lapsewise.operators.snapshots import as_dates, date_array, with_passed

LABEL_COLUMNS = (
    "customer_id", "snapshot_date", "horizon_days", "history_purchase_days", "history_invoices", "history_monetary",
    "first_purchase_in_window", "last_purchase_before_snapshot", "observation_start", "recency_at_snapshot",
    "observed_tenure_in_window", "customer_stage_at_snapshot", "next_purchase_date", "days_to_next_purchase",
    "label_end_date", "returned_within_horizon", "churn",
)


def recent_snapshots(df: DataFrame, dates: Sequence[date], day: str, reach: int) -> DataFrame:
    """Repeat each row for the snapshots T with day < T <= day + reach; adds `_index` and `snapshot_date`."""
    reached = df.withColumn("_reach", F.date_add(day, reach))
    both = with_passed(with_passed(reached, dates, day, "_from"), dates, "_reach", "_to")
    return both.filter(F.col("_from") < F.col("_to")).withColumn(
        "_index", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))
    ).withColumn("snapshot_date", F.get(date_array(dates), F.col("_index"))).drop("_reach", "_from", "_to")


def snapshot_labels(
    days: DataFrame,
    snapshots: Sequence,
    horizons: Sequence[int] = (fixed.HORIZON_DAYS,),
    history_days: int | Sequence[int] = fixed.HISTORY_DAYS,
    dataset_end: date | None = None,
) -> DataFrame:
    """One row per eligible customer, snapshot and horizon (and history window, when several).

    Eligible: a purchase in [T - history, T). Churned: none in [T, T + horizon).
    Each purchase day already knows the customer's next one, and the last day before T knows
    the first one from T on. So labels need no join with the future: one window per customer,
    a bounded repeat over snapshots, one aggregation on the same partitioning.
    """
    require_columns(days, DAY_COLUMNS, "purchase_days")
    windows = sorted(history_days) if isinstance(history_days, (list, tuple)) else [history_days]
    require_positive(history_days=windows, horizons=list(horizons))
    dates = as_dates(snapshots)
    if dataset_end is None:
        dataset_end = days.agg(F.max("purchase_day")).first()[0]
    late = [d for d in dates if d + timedelta(days=max(horizons)) > dataset_end]
    if late:
        raise ValueError(f"snapshots without a complete outcome window: {late}")

    # Rows repeat after they moved: the parts of a written table follow its rows.
    if getattr(days, "_written_at", None):
        days = scans.spread(days, ["customer_id"])
    own = W.partitionBy("customer_id").orderBy("purchase_day")
    linked = days.select(*DAY_COLUMNS).withColumn("_next", F.lead("purchase_day").over(own))
    spread = recent_snapshots(linked, dates, "purchase_day", windows[-1])
    keys = ["customer_id", "snapshot_date"]
    if len(windows) > 1:
        age = F.datediff("snapshot_date", "purchase_day")
        fitting = F.filter(F.array(*[F.lit(w) for w in windows]), lambda w: w >= age)
        spread = spread.withColumn("history_window_days", F.explode(fitting))
        keys.append("history_window_days")
    history = F.col("history_window_days") if len(windows) > 1 else F.lit(windows[0])
    eligible = spread.groupBy(*keys).agg(
        F.count("purchase_day").alias("history_purchase_days"),
        F.sum("invoices").alias("history_invoices"),
        F.sum("daily_value").alias("history_monetary"),
        F.min("purchase_day").alias("first_purchase_in_window"),
        F.max("purchase_day").alias("last_purchase_before_snapshot"),
        F.max_by("_next", "purchase_day").alias("next_purchase_date"),
    )
    labelled = eligible.withColumns({
        "observation_start": F.date_sub("snapshot_date", history),
        "recency_at_snapshot": F.datediff("snapshot_date", "last_purchase_before_snapshot"),
        "observed_tenure_in_window": F.datediff("last_purchase_before_snapshot", "first_purchase_in_window"),
        "customer_stage_at_snapshot": F.when(F.col("history_purchase_days") == 1, fixed.ONE_DAY_STAGE).otherwise(
            fixed.REPEAT_STAGE
        ),
        "days_to_next_purchase": F.datediff("next_purchase_date", "snapshot_date"),
        "horizon_days": F.explode(F.array(*[F.lit(h) for h in horizons])),
    })
    returned = F.coalesce(F.col("next_purchase_date") < F.col("label_end_date"), F.lit(False)).cast("int")
    labelled = labelled.withColumn("label_end_date", F.date_add("snapshot_date", F.col("horizon_days")))
    labelled = labelled.withColumn("returned_within_horizon", returned)
    labelled = labelled.withColumn("churn", 1 - F.col("returned_within_horizon"))
    extra = ["history_window_days"] if len(windows) > 1 else []
    return labelled.select(*LABEL_COLUMNS, *extra)


def prevalence(labels: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows, churned and returned counts with their rates and the Wilson interval of the churn rate."""
    table = labels.groupBy(*by).agg(
        F.count(F.lit(1)).alias("customer_snapshots"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.sum("churn").alias("churned"),
        F.sum("returned_within_horizon").alias("returned"),
    )
    low, high = wilson(F.col("churned"), F.col("customer_snapshots"))
    return table.withColumns({
        "churn_rate": F.col("churned") / F.col("customer_snapshots"),
        "return_rate": F.col("returned") / F.col("customer_snapshots"),
        "churn_rate_lower": low,
        "churn_rate_upper": high,
    })


def prevalence_matrix(labels: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Snapshot rows, one churn-rate column per horizon."""
    matrix = labels.groupBy("snapshot_date").pivot("horizon_days", list(horizons)).agg(F.avg("churn"))
    return matrix.select("snapshot_date", *[F.col(str(h)).alias(f"churn_rate_{h}d") for h in horizons])


def recency_band_prevalence(labels: DataFrame) -> DataFrame:
    value = F.col("recency_at_snapshot")
    return labels.groupBy(
        "horizon_days", binned(value, fixed.RECENCY_BINS).alias("recency_band"),
        bin_order(value, fixed.RECENCY_BINS).alias("band_order"),
    ).agg(
        F.count(F.lit(1)).alias("customer_snapshots"), F.sum("churn").alias("churned"),
        F.avg("churn").alias("churn_rate"),
    )


def _one_day_share() -> Column:
    return F.avg((F.col("customer_stage_at_snapshot") == fixed.ONE_DAY_STAGE).cast("int"))


def history_by_snapshot(labels: DataFrame) -> DataFrame:
    """Population and label statistics per history window and snapshot."""
    by = ["history_window_days", "snapshot_date"]
    means = labels.groupBy(*by).agg(
        F.count("customer_id").alias("eligible_customers"),
        F.avg("churn").alias("churn_rate"),
        F.avg("history_purchase_days").alias("mean_purchase_days"),
        F.avg("history_invoices").alias("mean_invoices"),
        F.avg("history_monetary").alias("mean_monetary"),
    )
    return means.join(exact_quantiles(labels, "recency_at_snapshot", {"median_recency": 0.5}, by), by)


def history_summary(labels: DataFrame) -> DataFrame:
    """One row per history window: pooled statistics and how stable they are over snapshots."""
    by = ["history_window_days"]
    pooled = labels.groupBy(*by).agg(
        F.count("customer_id").alias("customer_snapshots"),
        F.countDistinct("customer_id").alias("unique_customers"),
        F.avg("churn").alias("churn_rate"),
        _one_day_share().alias("one_purchase_share"),
    )
    medians = quantile_table(labels, {
        "median_recency": ("recency_at_snapshot", 0.5), "median_purchase_days": ("history_purchase_days", 0.5),
        "median_invoices": ("history_invoices", 0.5), "median_monetary": ("history_monetary", 0.5),
    }, by)
    pooled = pooled.join(medians, by)
    monthly = labels.groupBy(*by, "snapshot_date").agg(
        F.count("customer_id").alias("n"), F.avg("churn").alias("rate")
    ).groupBy(*by).agg(
        F.avg("n").alias("average_eligible_customers"),
        F.min("n").alias("minimum_eligible_customers"),
        F.max("n").alias("maximum_eligible_customers"),
        F.stddev_samp("rate").alias("churn_rate_std"),
    )
    return pooled.join(monthly, by)


def added_population(labels: DataFrame, windows: Sequence[int] = fixed.HISTORY_WINDOWS) -> DataFrame:
    """Customers a longer history window adds over the next shorter one, per snapshot.

    A customer belongs to every window at least as long as the recency, so the added ones
    are those whose recency exceeds the shorter window: no set difference is needed.
    """
    windows = sorted(windows)
    shorter = F.create_map(*[F.lit(v) for pair in zip(windows[1:], windows[:-1]) for v in pair])
    pairs = labels.withColumn("_shorter", shorter[F.col("history_window_days")])
    added = pairs.filter(F.col("recency_at_snapshot") > F.col("_shorter")).withColumn(
        "comparison",
        F.concat(
            F.lit("Added by "), F.col("history_window_days").cast("string"), F.lit(" vs "),
            F.col("_shorter").cast("string"), F.lit(" days"),
        ),
    )
    by = ["snapshot_date", "comparison"]
    found = added.groupBy(*by).agg(
        F.count("customer_id").alias("added_customers"), F.avg("churn").alias("added_churn_rate"),
        _one_day_share().alias("added_one_purchase_share"),
    ).join(exact_quantiles(added, "recency_at_snapshot", {"added_median_recency": 0.5}, by), by)
    names = [f"Added by {wide} vs {short} days" for short, wide in zip(windows, windows[1:])]
    spine = labels.select("snapshot_date").distinct().withColumn(
        "comparison", F.explode(F.array(*[F.lit(n) for n in names]))
    )
    return spine.join(found, by, "left").fillna(0, ["added_customers"])


def added_population_summary(added: DataFrame) -> DataFrame:
    """Averages over snapshots; the table has one row per snapshot and comparison, so medians are small."""
    return added.groupBy("comparison").agg(
        F.avg("added_customers").alias("average_added_customers"),
        F.avg("added_churn_rate").alias("added_churn_rate"),
        F.percentile("added_median_recency", 0.5).alias("added_median_recency"),
        F.avg("added_one_purchase_share").alias("added_one_purchase_share"),
    )


def windows_nested(labels: DataFrame, windows: Sequence[int] = fixed.HISTORY_WINDOWS) -> DataFrame:
    """Customers of a window missing from the next longer one; zero when windows nest as they must."""
    seen = labels.select("customer_id", "snapshot_date", "history_window_days")
    windows = sorted(windows)
    following = F.create_map(*[F.lit(v) for pair in zip(windows[:-1], windows[1:]) for v in pair])
    expected = seen.withColumn("history_window_days", following[F.col("history_window_days")]).filter(
        F.col("history_window_days").isNotNull()
    )
    missing = expected.join(seen, ["customer_id", "snapshot_date", "history_window_days"], "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("missing_customers"))


def label_checks(labels: DataFrame, dataset_end: date) -> DataFrame:
    """Counts of label rows that break a rule; all zero for sound labels."""
    return labels.agg(
        count_if(F.col("churn") + F.col("returned_within_horizon") != 1).alias("not_complementary"),
        count_if(F.col("last_purchase_before_snapshot") >= F.col("snapshot_date")).alias("history_after_snapshot"),
        count_if(F.col("label_end_date") > F.lit(dataset_end)).alias("incomplete_outcome"),
        count_if(F.col("next_purchase_date") < F.col("snapshot_date")).alias("next_before_snapshot"),
        count_if(F.col("recency_at_snapshot") < 1).alias("recency_below_one"),
    )


def horizon_checks(labels: DataFrame) -> DataFrame:
    """Snapshots whose population differs between horizons or whose churn rate rises with the horizon."""
    table = labels.groupBy("snapshot_date", "horizon_days").agg(
        F.count(F.lit(1)).alias("n"), F.avg("churn").alias("rate")
    )
    by = W.partitionBy("snapshot_date").orderBy("horizon_days")
    stepped = table.withColumns({"_n": F.lag("n").over(by), "_rate": F.lag("rate").over(by)})
    return stepped.agg(
        count_if(F.col("n") != F.col("_n")).alias("population_changes"),
        count_if(F.col("rate") > F.col("_rate")).alias("rate_rises"),
    )
