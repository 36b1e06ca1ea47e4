import datetime as dt

import pytest
from pyspark.sql import functions as F

from lapsewise.operators import cleaning

CODES = {
    "POST": "operational_fee", "BANK CHARGES": "operational_fee", "AMAZONFEE": "operational_fee",
    "DOT": "operational_fee", "TEST001": "test_dummy", "TEST002": "test_dummy", "C3": "unclear", "GIFT": "unclear",
    "gift_0001_20": "gift_voucher", "gift_0001_50": "gift_voucher", "85123A": "product_standard",
    "21733": "product_standard", "47503J": "product_standard", "DCGS0058": "product_alt_sku",
    "SP1002": "product_alt_sku", "47503J ": "product_standard", "\t21733\n": "product_standard",
    "post": "product_alt_sku", "123456": "product_alt_sku",
}
INVOICES = {
    "536365": "sale", "C536379": "cancellation", "A563185": "adjustment", "c536379": "other", "CA12": "other",
    "AB1": "other", None: "sale", "": "sale",
}


def test_code_categories(spark):
    df = spark.createDataFrame([(k,) for k in CODES], "stock_code string")
    raw = df.withColumn("raw", F.col("stock_code"))
    found = {r.raw: r.stockcode_category for r in cleaning.with_code_category(raw).collect()}
    assert found == CODES


def test_whitespace_is_stripped(spark):
    df = spark.createDataFrame([("47503J ",), ("\t21733\n",)], "stock_code string")
    assert [r.stock_code for r in cleaning.with_code_category(df).collect()] == ["47503J", "21733"]


def test_invoice_types(spark):
    df = spark.createDataFrame([(k,) for k in INVOICES], "invoice string")
    assert {r.invoice: r.invoice_type for r in cleaning.with_invoice_type(df).collect()} == INVOICES


def test_clean_lines_keep_exactly_the_unexcluded(spark):
    when = dt.datetime(2021, 1, 1)
    rows = [(c, code, inv, 1.0, 2.0, when) for c in (1.0, None) for code in CODES for inv in INVOICES]
    df = spark.createDataFrame(
        rows, "customer_id double, stock_code string, invoice string, quantity double, price double, invoice_date timestamp"
    )
    kept = cleaning.clean_lines(df)
    tagged = cleaning.with_exclusion_reason(df)
    assert kept.count() == tagged.filter("exclusion_reason is null").count() > 0
    assert dict(kept.dtypes)["customer_id"] == "bigint"
    reasons = {r.exclusion_reason for r in tagged.select("exclusion_reason").distinct().collect()}
    assert reasons == {None, "adjustment", "operational_fee", "test_dummy", "unclear", "no_customer"}


def test_missing_columns(spark):
    with pytest.raises(ValueError, match="invoice_date"):
        cleaning.clean_lines(spark.createDataFrame([(1,)], "customer_id int"))
