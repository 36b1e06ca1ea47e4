"""Orders, purchase days, the gaps between them and calendar activity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from lapsewise.functions import fixed
from lapsewise.functions.checks import require_columns
from lapsewise.functions.numeric import beside, bin_order, binned, count_if, exact_quantiles, lookup, whole_days
from lapsewise.operators.scans import lag, ordered_scan, position, prefix, spread, total

DAY_COLUMNS = ("customer_id", "purchase_day", "daily_value", "invoices")


def order_table(purchases: DataFrame) -> DataFrame:
    return purchases.groupBy("customer_id", "invoice").agg(
        F.min("invoice_date").alias("purchase_date"),
        F.sum("net_revenue").alias("order_value"),
        F.sum("remaining_quantity").alias("units"),
        F.countDistinct("stock_code").alias("unique_products"),
    )


def purchase_days(purchases: DataFrame) -> DataFrame:
    """One row per customer and day with at least one retained purchase."""
    orders = purchases.groupBy("customer_id", "invoice").agg(
        F.to_date(F.min("invoice_date")).alias("purchase_day"), F.sum("net_revenue").alias("order_value")
    )
    return _days(orders)


def purchase_days_of_lots(lots: DataFrame) -> DataFrame:
    """The same table from sale lifetimes: units never cancelled are the retained purchases.

    Both sums over written lifetimes take place in parts that follow their rows.
    """
    rows = lots.count() if getattr(lots, "_written_at", None) else 0
    kept = lots.filter(F.col("close_day").isNull()).select(
        "customer_id", "invoice", "open_day", (F.col("units") * F.col("price")).alias("_value")
    )
    orders = spread(kept, ["customer_id", "invoice"], rows).groupBy("customer_id", "invoice").agg(
        F.min("open_day").alias("purchase_day"), F.sum("_value").alias("order_value")
    )
    return _days(spread(orders, ["customer_id", "purchase_day"], rows))


def _days(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id", "purchase_day").agg(
        F.sum("order_value").alias("daily_value"), F.count("invoice").alias("invoices")
    )


def order_profile(orders: DataFrame) -> DataFrame:
    """Per customer: orders, first and last purchase, value and the one-time/repeat type."""
    return orders.groupBy("customer_id").agg(
        F.count("invoice").alias("orders"),
        F.min("purchase_date").alias("first_purchase"),
        F.max("purchase_date").alias("last_purchase"),
        F.sum("order_value").alias("total_value"),
    ).withColumn("customer_type", F.when(F.col("orders") == 1, "One-time").otherwise("Repeat"))


def customer_types(profile: DataFrame) -> DataFrame:
    counts = profile.groupBy("customer_type").agg(F.count(F.lit(1)).alias("customers"))
    return counts.withColumn("share", F.col("customers") / F.sum("customers").over(W.partitionBy()))


def order_gaps(orders: DataFrame) -> DataFrame:
    """Time since the customer's previous order, for every order but the first."""
    rows = orders.select("customer_id", "invoice", "purchase_date")

    def run(scan):
        return scan.add(previous_purchase=lag("purchase_date")).df

    gaps = ordered_scan(rows, ["customer_id"], ["purchase_date", "invoice"], run)
    micros = F.unix_micros(F.col("purchase_date").cast("timestamp")) - F.unix_micros(
        F.col("previous_purchase").cast("timestamp")
    )
    return gaps.filter(F.col("previous_purchase").isNotNull()).withColumns({
        "gap_hours": micros / 3.6e9,
        "gap_days_exact": micros / 8.64e10,
        "gap_days": F.datediff("purchase_date", "previous_purchase"),
    })


def short_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        count_if(F.col("gap_days") == 0).alias("same_day"),
        count_if(F.col("gap_days_exact") <= 1).alias("within_1_day"),
        count_if(F.col("gap_days_exact") <= 7).alias("within_7_days"),
        F.count(F.lit(1)).alias("all_gaps"),
        F.avg((F.col("gap_days") == 0).cast("int")).alias("same_day_share"),
    )


def day_gaps(days: DataFrame) -> DataFrame:
    """Calendar days between consecutive purchase days of a customer.

    A customer has at most one row per calendar day, so the plain window is bounded.
    """
    require_columns(days, ["customer_id", "purchase_day"], "purchase_days")
    previous = F.lag("purchase_day").over(W.partitionBy("customer_id").orderBy("purchase_day"))
    return (
        days.select("customer_id", "purchase_day", previous.alias("previous_day"))
        .filter(F.col("previous_day").isNotNull())
        .withColumn("gap_days", F.datediff("purchase_day", "previous_day"))
    )


def gap_distribution(gaps: DataFrame) -> DataFrame:
    """Empirical distribution of gaps: every gap with its position over the sorted gaps."""

    def run(scan):
        return scan.add(position=position(), _n=total("sum", F.lit(1))).df

    ranked = ordered_scan(
        gaps.select("customer_id", "purchase_day", "gap_days"), [], ["gap_days", "customer_id", "purchase_day"], run
    )
    return ranked.withColumn("cumulative_share", F.col("position") / F.col("_n")).drop("_n")


def gap_quantiles(gaps: DataFrame) -> DataFrame:
    return exact_quantiles(
        gaps, "gap_days", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p80": 0.8, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    )


def customer_gaps(gaps: DataFrame) -> DataFrame:
    return gaps.groupBy("customer_id").agg(
        F.count("gap_days").alias("observed_gaps"),
        F.percentile("gap_days", 0.5).alias("median_gap_days"),
        F.avg("gap_days").alias("mean_gap_days"),
        F.max("gap_days").alias("max_gap_days"),
    )


def cadence_groups(per_customer: DataFrame) -> DataFrame:
    value = F.col("median_gap_days")
    counts = per_customer.groupBy(
        binned(value, fixed.CADENCE_BINS).alias("cadence"), bin_order(value, fixed.CADENCE_BINS).alias("cadence_order")
    ).agg(F.count(F.lit(1)).alias("customers"))
    return counts.withColumn("share", F.col("customers") / F.sum("customers").over(W.partitionBy()))


def horizon_coverage(gaps: DataFrame, purchases: DataFrame, horizons: Sequence[int] = fixed.HORIZONS) -> DataFrame:
    """How many observed gaps each candidate horizon covers, and its latest usable snapshot."""
    columns = [count_if(F.col("gap_days") <= h).alias(f"h{h}") for h in horizons]
    summary = gaps.agg(F.count(F.lit(1)).alias("n"), *columns)
    end = purchases.agg(F.max("invoice_date").alias("dataset_end"))
    rows = F.array(*[
        F.struct(F.lit(h).alias("horizon_days"), F.col(f"h{h}").alias("gaps_captured")) for h in horizons
    ])
    table = summary.select("n", F.explode(rows).alias("_h")).select("n", "_h.*")
    return table.withColumn("dataset_end", end.scalar()).select(
        "horizon_days",
        (F.col("gaps_captured") / F.col("n")).alias("captured_share"),
        ((F.col("n") - F.col("gaps_captured")) / F.col("n")).alias("beyond_share"),
        "gaps_captured",
        (F.col("n") - F.col("gaps_captured")).alias("gaps_beyond"),
        F.date_sub("dataset_end", F.col("horizon_days")).alias("latest_usable_snapshot"),
        lookup(F.col("horizon_days"), fixed.HORIZON_NOTES).alias("note"),
    )


def month_spine(df: DataFrame, day: str) -> DataFrame:
    """Every month from the first to the last, also those without rows."""
    span = df.agg(F.trunc(F.min(day), "MM").alias("a"), F.trunc(F.max(day), "MM").alias("b"))
    return span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))


def monthly_activity(orders: DataFrame) -> DataFrame:
    per_month = orders.groupBy(F.trunc("purchase_date", "MM").alias("month")).agg(
        F.count("invoice").alias("orders"),
        F.countDistinct("customer_id").alias("active_customers"),
        F.sum("order_value").alias("revenue"),
    )
    return month_spine(per_month, "month").join(per_month, "month", "left").fillna(
        0, ["orders", "active_customers", "revenue"]
    )


def monthly_rows(lines: DataFrame) -> DataFrame:
    per_month = lines.groupBy(F.trunc("invoice_date", "MM").alias("month")).agg(F.count(F.lit(1)).alias("rows"))
    return month_spine(per_month, "month").join(per_month, "month", "left").fillna(0, ["rows"])


def month_of_year(orders: DataFrame) -> DataFrame:
    per_month = orders.groupBy(F.month("purchase_date").alias("month_number")).agg(
        F.count("invoice").alias("orders"),
        F.countDistinct("customer_id").alias("active_customers"),
        F.sum("order_value").alias("revenue"),
    )
    spine = orders.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month_number"))
    return spine.join(per_month, "month_number", "left").fillna(0, ["orders", "active_customers", "revenue"])


def follow_up(orders: DataFrame, purchases: DataFrame) -> DataFrame:
    """Days each customer was observable after the last purchase."""
    end = purchases.agg(F.max("invoice_date").alias("dataset_end"))
    last = orders.groupBy("customer_id").agg(
        F.max("purchase_date").alias("last_purchase"), F.count("invoice").alias("orders")
    )
    return last.withColumn("dataset_end", end.scalar()).withColumn(
        "observed_days", whole_days(F.col("last_purchase"), F.col("dataset_end"))
    ).drop("dataset_end")


def follow_up_summary(observed: DataFrame) -> DataFrame:
    moments = observed.agg(
        F.count("observed_days").alias("customers"), F.avg("observed_days").alias("mean_days"),
        F.stddev_samp("observed_days").alias("std_days"),
        F.min("observed_days").alias("min_days"), F.max("observed_days").alias("max_days"),
    )
    quantiles = exact_quantiles(
        observed, "observed_days", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    )
    return beside(moments, quantiles)


def pareto_curve(values: DataFrame, value: str, key: str = "customer_id") -> DataFrame:
    """Customers by value descending, with their rank share and the cumulative value share."""

    def run(scan):
        return scan.add(
            position=position(), _n=total("sum", F.lit(1)),
            _cum=prefix("sum", F.col(value)), _all=total("sum", F.col(value)),
        ).df

    ranked = ordered_scan(values.select(key, value), [], [F.col(value).desc(), F.col(key)], run)
    return ranked.select(
        key, value, "position",
        (F.col("position") / F.col("_n")).alias("rank_share"), (F.col("_cum") / F.col("_all")).alias("value_share"),
    )


def top_share(curve: DataFrame, value: str, fraction: float = 0.01) -> DataFrame:
    """Value share of the top `fraction` of a Pareto curve (at least one row)."""
    rows = curve.agg(F.greatest(F.lit(1), F.floor(F.max("position") * fraction)).alias("n"))
    top = F.col("position") <= F.col("_top_rows")
    return curve.withColumn("_top_rows", rows.scalar()).agg(
        count_if(top).alias("top_rows"),
        (F.sum(F.when(top, F.col(value))) / F.sum(value)).alias("top_value_share"),
    )
