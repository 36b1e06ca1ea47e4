"""Ordered scans (running sums, lags, ranks) that also hold for very large groups.

A window function sorts each group inside one task. That is right for ordinary
groups, and wrong for a group holding a large share of all rows, or for a window
with no group at all. `ordered_scan` keeps the plain window for ordinary groups
and cuts only the hot ones into contiguous blocks of bounded size:

1. range-partition the hot rows by (keys, order) and keep the partition number;
2. run the window inside each block;
3. reduce every block to one row, scan those few rows, and add the carry back.

Both ways run the same steps of the caller, so results do not depend on the data's shape.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from lapsewise.session import GROUP_ROWS, materialise, setting, written

BLOCK = "_block"
POS = "_pos"
BUCKETS = 1 << 16  # hashes of keys that rows are counted by
TASK_ROWS = 100_000  # rows of an ordinary task

_REDUCE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Step:
    """One scanned column: `kind` is prefix, suffix, total, lag or lead."""

    kind: str
    reduce: str
    value: Column

    def over(self, by: list[str], order: list[Column]) -> Column:
        ordered = W.partitionBy(*by).orderBy(*order)
        if self.kind == "lag":
            return F.lag(self.value).over(ordered)
        if self.kind == "lead":
            return F.lead(self.value).over(ordered)
        if self.kind == "total":
            return _REDUCE[self.reduce](self.value).over(W.partitionBy(*by))
        if self.kind == "suffix":
            return _REDUCE[self.reduce](self.value).over(ordered.rowsBetween(0, W.unboundedFollowing))
        running = ordered.rowsBetween(W.unboundedPreceding, 0)
        if self.reduce == "last":
            return F.last(self.value, ignorenulls=True).over(running)
        return _REDUCE[self.reduce](self.value).over(running)

    def of_block(self) -> Column:
        if self.kind == "lag":
            return F.max_by(self.value, POS)
        if self.kind == "lead":
            return F.min_by(self.value, POS)
        if self.reduce == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), F.col(POS)))
        return _REDUCE[self.reduce](self.value)

    def carry(self, by: list[str], reduced: str) -> Column:
        blocks = W.partitionBy(*by).orderBy(BLOCK)
        if self.kind == "lag":
            return F.lag(reduced).over(blocks)
        if self.kind == "lead":
            return F.lead(reduced).over(blocks)
        if self.kind == "total":
            return _REDUCE[self.reduce](reduced).over(W.partitionBy(*by))
        if self.kind == "suffix":
            return _REDUCE[self.reduce](reduced).over(blocks.rowsBetween(1, W.unboundedFollowing))
        before = blocks.rowsBetween(W.unboundedPreceding, -1)
        if self.reduce == "last":
            return F.last(reduced, ignorenulls=True).over(before)
        return _REDUCE[self.reduce](reduced).over(before)

    def join(self, local: Column, carry: Column) -> Column:
        if self.kind == "lag":
            return F.when(F.col(POS) == 1, carry).otherwise(local)
        if self.kind == "lead":
            return F.when(F.col(POS) == F.col("_block_rows"), carry).otherwise(local)
        if self.kind == "total":
            return carry
        if self.reduce == "sum":
            return F.coalesce(local + carry, local, carry)
        if self.reduce == "min":
            return F.least(local, carry)
        if self.reduce == "max":
            return F.greatest(local, carry)
        return F.coalesce(local, carry)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def prefix(reduce: str, value) -> Step:
    return Step("prefix", reduce, _col(value))


def suffix(reduce: str, value) -> Step:
    return Step("suffix", reduce, _col(value))


def total(reduce: str, value) -> Step:
    return Step("total", reduce, _col(value))


def lag(value) -> Step:
    return Step("lag", "", _col(value))


def lead(value) -> Step:
    return Step("lead", "", _col(value))


def position() -> Step:
    """1-based row number in the group."""
    return Step("prefix", "sum", F.lit(1).cast("bigint"))


@dataclass(frozen=True)
class Scan:
    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    blocked: bool = False

    def add(self, **steps: Step) -> "Scan":
        """Add scanned columns; steps of one call must not refer to each other."""
        keys, order = list(self.keys), list(self.order)
        if not self.blocked:
            return replace(self, df=self.df.withColumns({n: s.over(keys, order) for n, s in steps.items()}))
        inside = keys + [BLOCK]
        local = {f"_in_{n}": s.over(inside, order) for n, s in steps.items() if s.kind != "total"}
        df = self.df.withColumns(local | {POS: F.row_number().over(W.partitionBy(*inside).orderBy(*order))})
        blocks = df.groupBy(*inside).agg(
            F.count(F.lit(1)).alias("_block_rows"), *[s.of_block().alias(f"_of_{n}") for n, s in steps.items()]
        )
        carried = blocks.select(
            *inside, "_block_rows", *[s.carry(keys, f"_of_{n}").alias(f"_carry_{n}") for n, s in steps.items()]
        )
        # One row per (hot key, block); keys may be null.
        carried = carried.withColumnsRenamed({c: f"_of_{c}" for c in inside})
        same = F.lit(True)
        for c in inside:
            same &= df[c].eqNullSafe(carried[f"_of_{c}"])
        joined = df.join(carried, same).drop(*[f"_of_{c}" for c in inside])
        combined = {
            n: s.join(F.col(f"_in_{n}") if s.kind != "total" else F.lit(None), F.col(f"_carry_{n}"))
            for n, s in steps.items()
        }
        joined = joined.withColumns(combined)
        return replace(self, df=joined.select(*self.df.columns, *steps))

    def with_columns(self, **columns: Column) -> "Scan":
        return replace(self, df=self.df.withColumns(columns))

    def reordered(self, df: DataFrame, *order) -> "Scan":
        """The same groups over new rows and a new order; hot rows are cut again."""
        columns = tuple(_col(c) for c in order)
        if not self.blocked:
            return replace(self, df=df, order=columns)
        return replace(self, df=cut_blocks(df.drop(BLOCK), self.keys, columns), order=columns)


def cut_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Number contiguous blocks of at most about GROUP_ROWS rows."""
    spark = df.sparkSession
    # Written first: counting, sampling the range bounds and the shuffle then read a plain table.
    df = materialise(df)
    rows = df.count()
    blocks = max(2, int(-(-rows // setting(spark, GROUP_ROWS))) * 2)
    ranged = df.repartitionByRange(blocks, *[F.col(k) for k in keys], *order)
    # Writing the rows fixes the partition numbers: range bounds are sampled afresh by every job.
    return materialise(ranged.withColumn(BLOCK, F.spark_partition_id()))


def hot_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """Keys whose group is larger than one task should sort; None when there are none.

    `df` is a written table: its rows are counted from the file footers, and a table of no more
    rows than one task may sort has no such group. Otherwise rows are counted by a hash of the keys, which
    moves BUCKETS counts a task; a hot group makes its bucket exceed the limit, so only groups of such buckets are counted.
    """
    most = setting(df.sparkSession, GROUP_ROWS)
    if df.count() <= most:
        return None
    if not keys:
        return df.sparkSession.range(1)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).alias("_bucket")
    counted = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most)
    full = [r["_bucket"] for r in counted.collect()]
    if not full:
        return None
    inside = df.filter(bucket.isin(full)) if len(full) < BUCKETS // 8 else df
    found = materialise(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > most).drop("_rows"))
    return None if found.isEmpty() else found


def parts_for(spark: SparkSession, rows: int) -> int:
    """Parts of about TASK_ROWS rows, so that what a task sorts does not grow with the table."""
    return max(-(-rows // TASK_ROWS), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """A written table dealt by key into parts whose number follows its rows.

    The engine sizes the parts of a shuffle by their packed bytes; what a task unpacks, sorts or repeats of them is
    many times that. A small table is left to the engine. `rows` is the most rows of a table that is not written.
    """
    rows = df.count() if rows is None else rows
    return df.repartition(parts_for(df.sparkSession, rows), *keys) if rows > TASK_ROWS else df


def ordered_scan(
    df: DataFrame, keys: Sequence[str], order: Sequence, run: Callable[[Scan], DataFrame]
) -> DataFrame:
    """Apply `run` to every group of `keys` in `order`, cutting hot groups into blocks.

    An empty `keys` treats the whole table as one group; a null key is a key like others. The input
    is written once, unless it is a written table, so that it is neither computed again for the
    count nor for the parts.
    """
    df = written(df)
    columns = tuple(_col(c) for c in order)
    keys = tuple(keys)
    hot = hot_groups(df, keys)
    plain = Scan(df, keys, columns)
    if hot is None:
        return run(replace(plain, df=spread(df, keys)) if keys else plain)
    if not keys:
        return run(Scan(cut_blocks(df, keys, columns), keys, columns, blocked=True)).drop(BLOCK)
    # At most rows / GROUP_ROWS keys are hot; Spark measures the table and chooses the join.
    same = F.lit(True)
    for key in keys:
        same &= df[key].eqNullSafe(hot[key])
    heavy, rest = df.join(hot, same, "left_semi"), df.join(hot, same, "left_anti")
    return run(replace(plain, df=rest)).unionByName(
        run(Scan(cut_blocks(heavy, keys, columns), keys, columns, blocked=True)).drop(BLOCK)
    )
