"""The driver's order tables seen as raw retail sales lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def sales_lines(spark: SparkSession, folder: str, country: bool = True) -> DataFrame:
    """orders ⋈ lineitem ⋈ part (⋈ customer ⋈ nation) in the raw sales-line schema.

    `country=False` leaves the two customer joins out for queries that do not show it.
    No join is forced to broadcast: Spark does so only for sides it has measured.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    part_number = F.substring_index("p_brand", "#", -1)
    standard = F.concat(F.lpad(part_number, 5, "0"), F.lit("A"))
    size = F.col("p_size")
    code = (
        F.when(size == 1, "POST").when(size == 2, "TEST001").when(size == 3, "C3")
        .when(size == 4, "gift_0001_20").when(size == 5, "DCGS0058")
        .when(size == 6, F.concat(standard, F.lit(" "))).otherwise(standard)
    )
    returned = F.col("l_returnflag") == "R"
    letter = F.when(returned, "C").when(
        (F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 7), "A"
    ).otherwise("")
    tier = F.round(F.col("l_extendedprice") / F.col("l_quantity") / 500) * 500
    joined = (
        table("lineitem")
        .join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    if country:
        joined = joined.join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
            table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        )
    quantity = F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    date = F.when(returned, F.col("l_shipdate")).otherwise(F.col("o_orderdate"))
    columns = [
        F.col("o_custkey").alias("customer_id"),
        code.alias("stock_code"),
        F.concat(letter, F.col("l_orderkey").cast("string")).alias("invoice"),
        F.col("p_name").alias("description"),
        quantity.alias("quantity"),
        F.greatest(F.lit(500.0), tier).alias("price"),
        date.alias("invoice_date"),
        F.concat(F.lit("Y"), F.year(date).cast("string")).alias("source_sheet"),
        F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"),
    ]
    if country:
        columns.append(F.col("n_name").alias("country"))
    tie_break = ("invoice", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "l_extendedprice")
    return joined.select(*columns).withColumn("row_seq", F.struct(*tie_break)).drop(*tie_break[1:4], tie_break[5])
