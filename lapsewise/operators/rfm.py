"""Recency/frequency/monetary tables and the comparison of netting policies."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.functions.checks import require_columns
from lapsewise.functions.numeric import beside, count_if, exact_quantiles, quantile_table, ratio, whole_days

RFM = ("recency", "frequency", "monetary")


def day_after_last(lines: DataFrame) -> Column:
    """One day after the last line, as a scalar subquery: no job of its own."""
    return lines.agg((F.max("invoice_date") + F.expr("interval 1 day")).alias("at")).scalar()


def rfm_table(purchases: DataFrame, snapshot: Column | datetime) -> DataFrame:
    """Whole 24-hour periods since the last purchase, distinct orders and net revenue per customer."""
    require_columns(purchases, ["customer_id", "invoice", "invoice_date", "net_revenue"], "purchases")
    snapshot = snapshot if isinstance(snapshot, Column) else F.lit(snapshot)
    per_order = purchases.groupBy("customer_id", "invoice").agg(
        F.max("invoice_date").alias("_last"), F.sum("net_revenue").alias("_value")
    )
    per_customer = per_order.groupBy("customer_id").agg(
        F.max("_last").alias("_last"), F.count("invoice").alias("frequency"), F.sum("_value").alias("monetary")
    )
    return per_customer.select(
        "customer_id", whole_days(F.col("_last"), snapshot).alias("recency"), "frequency", "monetary"
    )


def compare_policies(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer join of two RFM tables with the differences (second minus first)."""
    a = first.select("customer_id", *[F.col(c).alias(f"{c}_a") for c in RFM])
    b = second.select("customer_id", *[F.col(c).alias(f"{c}_b") for c in RFM])
    both = a.join(b, "customer_id", "full_outer")
    differences = {f"{c}_diff": F.col(f"{c}_b") - F.col(f"{c}_a") for c in RFM}
    return both.withColumns(differences).withColumn(
        "differs",
        F.coalesce(
            (F.abs("monetary_diff") > 1e-6) | (F.col("frequency_diff") != 0) | (F.col("recency_diff") != 0),
            F.lit(False),
        ).cast("int"),
    )


def policy_summary(compared: DataFrame) -> DataFrame:
    shared = F.col("recency_a").isNotNull() & F.col("recency_b").isNotNull()
    table = compared.agg(
        count_if(F.col("recency_b").isNull()).alias("only_in_first"),
        count_if(F.col("recency_a").isNull()).alias("only_in_second"),
        count_if(shared).alias("in_both"),
        count_if(F.col("differs") == 1).alias("differing"),
        F.sum(F.when(shared, F.col("monetary_a"))).alias("total_first"),
        F.sum(F.when(shared, F.col("monetary_b"))).alias("total_second"),
    )
    return table.withColumns({
        "differing_pct": ratio("differing", "in_both") * 100,
        "total_diff": F.col("total_second") - F.col("total_first"),
        "total_diff_pct": ratio(F.col("total_second") - F.col("total_first"), "total_first") * 100,
    })


def largest_differences(compared: DataFrame, k: int = 10) -> DataFrame:
    return compared.filter("differs = 1").orderBy(F.abs("monetary_diff").desc(), "customer_id").limit(k)


def without_purchase(lines: DataFrame, purchases: DataFrame) -> DataFrame:
    """Customers with lines but no net purchase, with what they did."""
    # One row per customer before the join: a customer with very many lines moves as one row.
    per_customer = lines.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("invoice").alias("invoices"),
        F.sum("quantity").alias("net_quantity"),
    )
    return per_customer.join(purchases.select("customer_id").distinct(), "customer_id", "left_anti")


def netting_effect(netted: DataFrame) -> DataFrame:
    """Sales fully kept, partly cancelled and fully cancelled."""
    sold, kept = F.col("quantity"), F.col("remaining_quantity")
    return netted.filter(sold > 0).agg(
        F.count(F.lit(1)).alias("sales"),
        count_if(kept == sold).alias("kept"),
        count_if((kept < sold) & (kept > 0)).alias("partly_cancelled"),
        count_if(kept == 0).alias("fully_cancelled"),
    )


def largest_line_verdict(lines: DataFrame) -> DataFrame:
    """Was the largest single line a wholesaler's order or a mistake its buyer reversed?"""
    rank = F.struct("quantity", "invoice_date", "invoice", "customer_id", "stock_code")
    top = lines.agg(F.max(rank).alias("t")).select(
        F.col("t.customer_id").alias("customer_id"), F.col("t.stock_code").alias("top_code"),
        F.col("t.invoice").alias("top_invoice"), F.col("t.quantity").alias("top_quantity"),
    )
    # One row: the aggregate above has no grouping.
    own = lines.join(F.broadcast(top), "customer_id")
    same = F.col("stock_code") == F.col("top_code")
    facts = own.groupBy("customer_id", "top_code", "top_invoice", "top_quantity").agg(
        F.sum("quantity").alias("net_quantity"),
        F.countDistinct("invoice").alias("invoices"),
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.col("quantity") * F.col("price")).alias("net_revenue"),
        F.datediff(
            F.max(F.when(same, F.col("invoice_date"))), F.min(F.when(same, F.col("invoice_date")))
        ).alias("days_between_item_rows"),
    )
    return facts.withColumn(
        "verdict",
        F.when(F.abs("net_quantity") < 0.05 * F.col("top_quantity"), "self-corrected")
        .when(F.col("invoices") > 1, "repeat activity")
        .otherwise("single invoice"),
    )


def top_quantity_customers(lines: DataFrame, k: int = 10) -> DataFrame:
    return lines.groupBy("customer_id").agg(F.sum("quantity").alias("net_quantity")).orderBy(
        F.desc("net_quantity"), "customer_id"
    ).limit(k)


def non_positive_customers(lines: DataFrame) -> DataFrame:
    """Customers whose raw line revenue sums to zero or less."""
    totals = lines.groupBy("customer_id").agg(
        F.sum(F.col("quantity") * F.col("price")).alias("raw_monetary"), F.count(F.lit(1)).alias("rows")
    )
    return totals.filter("raw_monetary <= 0")


def rfm_summary(rfm: DataFrame) -> DataFrame:
    """Customers, medians and 99 % limits of each RFM value."""
    wanted = {f"median_{c}": (c, 0.5) for c in RFM} | {f"p99_{c}": (c, 0.99) for c in RFM}
    return beside(rfm.agg(F.count(F.lit(1)).alias("customers")), quantile_table(rfm, wanted))


def representative_customers(rfm: DataFrame) -> DataFrame:
    """The customer with the largest monetary value and the one closest to its median."""
    median = exact_quantiles(rfm, "monetary", {"median": 0.5}).scalar()
    distance = rfm.withColumn("_median", median).withColumn("_away", F.abs(F.col("monetary") - F.col("_median")))
    row = F.struct("customer_id", *RFM)
    picked = distance.agg(
        F.max_by(row, F.struct("monetary", -F.col("customer_id"))).alias("largest"),
        F.min_by(row, F.struct("_away", "customer_id")).alias("median"),
    )
    return picked.selectExpr("stack(2, 'largest', largest, 'median', median) as (role, r)").select("role", "r.*")
