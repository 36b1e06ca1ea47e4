"""Profiles of raw lines and derived tables: counts, missing values, anomalies, shares, shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapsewise.functions.numeric import at_most, beside, count_if, exact_quantiles, quantile_table, sample_skewness


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, nulls and distinct values.

    Distinct values are counted by grouping (column, value) pairs, so no single task
    holds the values of a column.
    """
    columns = list(columns or df.columns)
    # Values become text once per row; every column is one entry of the array.
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    counted = df.select(F.explode(cells).alias("c")).groupBy("c.column_name", "c.value").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        F.count("value").alias("distinct_values"),
    )


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles: one row per column."""
    moments = df.agg(*[column for c in columns for column in (
        F.count(c).alias(f"_n_{c}"), F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"),
        F.min(c).cast("double").alias(f"_a_{c}"), F.max(c).cast("double").alias(f"_z_{c}"),
    )])
    quartiles = quantile_table(df, {f"_p{q}_{c}": (c, q / 100) for c in columns for q in (25, 50, 75)})
    names = {"rows": "_n", "mean": "_m", "std": "_s", "min": "_a", "p25": "_p25", "p50": "_p50", "p75": "_p75", "max": "_z"}
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{v}_{c}").alias(k) for k, v in names.items()])
        for c in columns
    ])
    return beside(moments, quartiles).select(F.explode(cells).alias("_c")).select("_c.*")


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null rows and their share, only for columns that have any."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_rows")) for c in columns])
    return counts.select("_n", F.explode(pairs).alias("p")).filter("p.missing_rows > 0").select(
        "p.*", (F.col("p.missing_rows") / F.col("_n")).alias("missing_share")
    )


def value_shares(df: DataFrame, *by: str) -> DataFrame:
    """Rows and share per value; the window sees one row per distinct value."""
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy()))


def exclusion_trail(tagged: DataFrame) -> DataFrame:
    """Lines left out of the analysis by reason, and those that stay."""
    return value_shares(
        tagged.withColumn("exclusion_reason", F.coalesce("exclusion_reason", F.lit("kept"))), "exclusion_reason"
    )


def anomaly_counts(lines: DataFrame, raw_code: str = "raw_stock_code") -> DataFrame:
    """Suspicious values per invoice type."""
    code = F.col(raw_code)
    return lines.groupBy("invoice_type").agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(F.col("price") == 0).alias("zero_price"),
        count_if(F.col("price") < 0).alias("negative_price"),
        count_if(F.col("quantity") > 0).alias("positive_quantity"),
        count_if(F.col("quantity") < 0).alias("negative_quantity"),
        count_if((F.col("quantity") < 0) & (F.col("invoice_type") != "cancellation")).alias("unexplained_negative"),
        count_if(code != F.col("stock_code")).alias("codes_with_whitespace"),
        count_if(F.col("customer_id").isNull()).alias("no_customer"),
    )


def special_codes(lines: DataFrame) -> DataFrame:
    """Stock codes off the ordinary pattern: rows, net quantity, net revenue, a sample description."""
    return lines.filter("stockcode_category <> 'product_standard'").groupBy("stockcode_category", "stock_code").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("quantity").alias("net_quantity"),
        F.sum(F.col("quantity") * F.col("price")).alias("net_revenue"), F.min("description").alias("sample_description"),
    )


def category_summary(lines: DataFrame) -> DataFrame:
    return lines.groupBy("stockcode_category").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("stock_code").alias("codes"),
        F.sum("quantity").alias("net_quantity"), F.sum(F.col("quantity") * F.col("price")).alias("net_revenue"),
    )


def top_with_other(df: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The k most frequent values; all others together as 'Other'."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("rows"))
    top = counts.orderBy(F.desc("rows"), by).limit(k).select(F.col(by).alias("_top"))
    # At most k rows.
    named = counts.join(F.broadcast(top), F.col(by) == F.col("_top"), "left")
    return named.groupBy(F.coalesce("_top", F.lit("Other")).alias(by)).agg(F.sum("rows").alias("rows"))


def distribution_shape(df: DataFrame, column: str) -> DataFrame:
    """Quantiles, interquartile range, mean, median and bias-corrected skewness of one column."""
    quantiles = exact_quantiles(df, column, {
        "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99,
    })
    moments = df.agg(F.avg(column).alias("mean"), F.max(column).alias("max"), sample_skewness(column).alias("skewness"))
    return beside(quantiles, moments).withColumn("iqr", F.col("p75") - F.col("p25")).withColumn(
        "nearly_symmetric", F.col("skewness").between(-0.5, 0.5).cast("int")
    )


def central_rows(df: DataFrame, column: str, quantile: float = 0.99) -> DataFrame:
    """Rows up to a quantile of the column."""
    limit = exact_quantiles(df, column, {"limit": quantile}).scalar()
    return df.withColumn("_limit", limit).filter(F.col(column) <= F.col("_limit")).drop("_limit")


def capped(df: DataFrame, columns: Sequence[str], quantile: float = 0.99) -> DataFrame:
    """Winsorize columns at their quantile; `<name>_capped` flags the rows that changed."""
    caps = quantile_table(df, {f"_cap_{c}": (c, quantile) for c in columns})
    joined = beside(df, caps)
    flags = {f"{c}_capped": F.coalesce(F.col(c) > F.col(f"_cap_{c}"), F.lit(False)).cast("int") for c in columns}
    values = {c: at_most(F.col(c), F.col(f"_cap_{c}")) for c in columns}
    return joined.withColumns(flags).withColumns(values).drop(*caps.columns)


def log_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.log1p(F.col(c).cast("double")) for c in columns})


def documentation_checks(lines: DataFrame, expected: dict, home: str) -> DataFrame:
    """Facts of the data next to what its documentation promises: one row per fact."""
    facts = lines.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct("customer_id").alias("customers"),
        F.countDistinct("country").alias("countries"),
        F.to_date(F.min("invoice_date")).cast("string").alias("first_day"),
        F.to_date(F.max("invoice_date")).cast("string").alias("last_day"),
        F.round(F.avg((F.col("country") == home).cast("double")), 6).alias("home_share"),
    )
    cells = F.array(*[
        F.struct(
            F.lit(name).alias("fact"), F.col(name).cast("string").alias("found"),
            F.lit(str(expected[name])).alias("documented"),
            (F.col(name).cast("string") == F.lit(str(expected[name]))).cast("int").alias("agrees"),
        ) for name in facts.columns if name in expected
    ])
    return facts.select(F.explode(cells).alias("f")).select("f.*")


def group_medians(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, exact median and their ratio per group, one row per group and column."""
    medians = quantile_table(df, {f"_p_{c}": (c, 0.5) for c in columns}, by)
    both = df.groupBy(*by).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns]).join(medians, list(by))
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_m_{c}").alias("mean"), F.col(f"_p_{c}").alias("median"))
        for c in columns
    ])
    return both.select(*by, F.explode(cells).alias("_c")).select(
        *by, "_c.*", F.try_divide("_c.mean", "_c.median").alias("mean_to_median")
    )
