"""Reading sales lines and passing tables between jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lapsewise.session import delete_folder, replace_folder

RAW_SCHEMA = T.StructType([
    T.StructField("Invoice", T.StringType()),
    T.StructField("StockCode", T.StringType()),
    T.StructField("Description", T.StringType()),
    T.StructField("Quantity", T.DoubleType()),
    T.StructField("InvoiceDate", T.TimestampType()),
    T.StructField("Price", T.DoubleType()),
    T.StructField("Customer ID", T.DoubleType()),
    T.StructField("Country", T.StringType()),
])
RAW_NAMES = {
    "Invoice": "invoice", "StockCode": "stock_code", "Description": "description", "Quantity": "quantity",
    "InvoiceDate": "invoice_date", "Price": "price", "Customer ID": "customer_id", "Country": "country",
}
FORMATS = ("csv", "parquet", "orc", "json")


def read_table(
    spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str | None = None, fmt: str | None = None
) -> DataFrame:
    """Read a table or a list of its files; text formats need a schema, columnar ones carry their own."""
    first = path if isinstance(path, str) else path[0]
    fmt = fmt or next((f for f in FORMATS if first.rstrip("/").endswith(f".{f}")), "parquet")
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt in ("csv", "json"):
        raise ValueError(f"reading {fmt} needs a schema")
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.load(path if isinstance(path, str) else list(path))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Write a table, replacing what is there once the new one is complete.

    The rows go to a folder beside the table first, so a table may be computed from its own old
    rows, and a failed write leaves the old table as it was.
    """
    spark, fresh = df.sparkSession, f"{path.rstrip('/')}.{uuid4()}"
    writer = df.write.format(fmt).partitionBy(*partition_by)
    try:
        if fmt == "csv":  # white space at either end of a value is part of it
            writer = writer.options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")
        writer.save(fresh)
    except Exception:
        delete_folder(spark, fresh)
        raise
    replace_folder(spark, fresh, path)


def load_sales_lines(spark: SparkSession, sources: Mapping[str, str | Sequence[str]], fmt: str = "parquet") -> DataFrame:
    """Union of the named sources (a folder or a list of files), each tagged with its `source_sheet`.

    `row_seq` fixes the order of rows with one timestamp: source, file and position in the file,
    so files must not change between reads.
    """
    lines = None
    for name, path in sources.items():
        raw = read_table(spark, path, RAW_SCHEMA if fmt in ("csv", "json") else None, fmt)
        row = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
        seq = F.struct(
            F.lit(name).alias("source"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block") if fmt != "parquet" else F.lit(0).alias("block"),
            row.alias("row"),
        )
        part = raw.select(
            *[F.col(f"`{o}`").cast(RAW_SCHEMA[o].dataType).alias(n) for o, n in RAW_NAMES.items()],
            F.lit(name).alias("source_sheet"), seq.alias("row_seq"),
        )
        lines = part if lines is None else lines.unionByName(part)
    missing = F.lit(None).cast("double")
    return lines.withColumns({c: F.nanvl(c, missing) for c in ("price", "quantity", "customer_id")})
