"""Classify raw sales lines and reduce them to customer merchandise lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.functions import fixed
from lapsewise.functions.checks import require_columns

LINE_COLUMNS = ("customer_id", "stock_code", "invoice", "quantity", "price", "invoice_date")


def _prefixed(invoice: Column, letter: str) -> Column:
    """The leading letters are exactly `letter`. The cheap test comes first: most invoices have none."""
    return invoice.startswith(letter) & invoice.rlike(f"^{letter}(?![A-Za-z])")


def invoice_type(invoice: Column) -> Column:
    return (
        F.when(invoice.isNull() | ~invoice.rlike("^[A-Za-z]"), "sale")
        .when(_prefixed(invoice, "C"), "cancellation")
        .when(_prefixed(invoice, "A"), "adjustment")
        .otherwise("other")
    )


def trimmed_code(code: Column) -> Column:
    return F.btrim(code, F.lit(fixed.WHITESPACE))


def code_category(code: Column) -> Column:
    """Category of an already trimmed stock code; the first rule that applies wins."""
    return (
        F.when(code.isin(*fixed.OPERATIONAL_CODES), "operational_fee")
        .when(code.isin(*fixed.TEST_CODES), "test_dummy")
        .when(code.isin(*fixed.UNCLEAR_CODES), "unclear")
        .when(code.startswith(fixed.GIFT_VOUCHER_PREFIX), "gift_voucher")
        .when(code.rlike(fixed.STANDARD_CODE_PATTERN), "product_standard")
        .otherwise("product_alt_sku")
    )


def with_invoice_type(lines: DataFrame) -> DataFrame:
    return lines.withColumn("invoice_type", invoice_type(F.col("invoice")))


def with_code_category(lines: DataFrame) -> DataFrame:
    return lines.withColumn("stock_code", trimmed_code(F.col("stock_code"))).withColumn(
        "stockcode_category", code_category(F.col("stock_code"))
    )


def with_exclusion_reason(lines: DataFrame) -> DataFrame:
    """Why a line is left out of the customer analysis; null for lines that stay."""
    tagged = with_code_category(with_invoice_type(lines))
    category = F.col("stockcode_category")
    return tagged.withColumn(
        "exclusion_reason",
        F.when(F.col("invoice_type") == "adjustment", "adjustment")
        .when(category.isin(*fixed.EXCLUDED_CATEGORIES), category)
        .when(F.col("customer_id").isNull(), "no_customer"),
    )


def clean_lines(lines: DataFrame) -> DataFrame:
    """Sales and cancellations of real products by known customers."""
    require_columns(lines, LINE_COLUMNS, "sales lines")
    # The excluded categories are code lists, so plain membership tests reach the scan.
    code, invoice = trimmed_code(F.col("stock_code")), F.col("invoice")
    kept = lines.filter(
        F.col("customer_id").isNotNull()
        & ~F.coalesce(_prefixed(invoice, "A"), F.lit(False))
        & ~F.coalesce(code.isin(*fixed.EXCLUDED_CODES), F.lit(False))
    )
    return with_code_category(with_invoice_type(kept)).withColumn(
        "customer_id", F.col("customer_id").cast("bigint")
    )


def with_revenue(lines: DataFrame) -> DataFrame:
    return lines.withColumn("revenue", F.col("quantity") * F.col("price"))


def sold_units(quantity: Column) -> Column:
    return F.greatest(quantity, F.lit(0.0))


def cancelled_units(quantity: Column) -> Column:
    return F.greatest(-quantity, F.lit(0.0))
