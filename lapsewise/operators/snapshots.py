"""Snapshot grids: month-start dates and the calendar that maps days to snapshots."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lapsewise.functions.checks import require_columns, require_positive


def month_starts(first: date, last: date) -> list[date]:
    """Month starts within [first, last]."""
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    starts = [date(m // 12, m % 12 + 1, 1) for m in months]
    return [d for d in starts if first <= d <= last]


def valid_range(start: date, end: date, history_days: int, horizon_days: int) -> tuple[date, date]:
    require_positive(history_days=history_days, horizon_days=horizon_days)
    first, last = start + timedelta(days=history_days), end - timedelta(days=horizon_days)
    if first > last:
        raise ValueError("the data does not cover one history window plus one outcome window")
    return first, last


def monthly_snapshots(purchase_days: DataFrame, history_days: int = 180, horizon_days: int = 90) -> list[date]:
    """Month starts with a complete history window before and a complete outcome window after them."""
    require_columns(purchase_days, ["purchase_day"], "purchase_days")
    require_positive(history_days=history_days, horizon_days=horizon_days)
    span = purchase_days.agg(F.min("purchase_day").alias("a"), F.max("purchase_day").alias("b")).first()
    if span.a is None:
        raise ValueError("purchase_days cannot be empty")
    return month_starts(*valid_range(span.a, span.b, history_days, horizon_days))


def as_dates(snapshots: Sequence) -> list[date]:
    dates = sorted({d.date() if hasattr(d, "date") else d for d in snapshots})
    if not dates:
        raise ValueError("at least one snapshot date is required")
    return dates


def date_array(dates: Sequence[date]) -> Column:
    return F.array(*[F.lit(d) for d in dates])


_calendars: dict[tuple, DataFrame] = {}


def calendar(spark: SparkSession, dates: Sequence[date]) -> DataFrame:
    """One row per calendar day from the day before the first snapshot to the last: `day`, `passed`.

    `passed` counts the snapshots up to and including the day, so the first snapshot after
    a day has index `passed`. The table has one row per day of the period, whatever the data. Its values are
    given: where they were computed, a condition on `passed` would be computed again for every row that looks a day up.
    """
    key = (spark.sparkContext.applicationId, str(spark._jsparkSession.sessionUUID()), *dates)
    if key not in _calendars:
        first = dates[0] - timedelta(days=1)
        days = [first + timedelta(days=i) for i in range((dates[-1] - first).days + 1)]
        rows = ", ".join(f"(DATE'{d}', {bisect_right(dates, d)})" for d in days)
        _calendars[key] = spark.sql(f"SELECT * FROM VALUES {rows} AS t(day, passed)")
    return _calendars[key]


def with_passed(df: DataFrame, dates: Sequence[date], day: str, name: str) -> DataFrame:
    """Attach the number of snapshots at or before `day`; a null day counts all of them."""
    first = dates[0] - timedelta(days=1)
    clipped = F.least(F.greatest(F.coalesce(day, F.lit(dates[-1])), F.lit(first)), F.lit(dates[-1]))
    days = calendar(df.sparkSession, dates).select(F.col("day").alias("_day"), F.col("passed").alias(name))
    return df.withColumn("_day", clipped).join(F.broadcast(days), "_day").drop("_day")


def at_open_snapshots(df: DataFrame, snapshots: Sequence, opened: str, closed: str) -> DataFrame:
    """Repeat each row for every snapshot after `opened` up to `closed` (null: to the last)."""
    dates = as_dates(snapshots)
    both = with_passed(with_passed(df, dates, opened, "_from"), dates, closed, "_to")
    spread = both.filter(F.col("_from") < F.col("_to")).withColumn(
        "_index", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1))
    )
    return spread.withColumn("snapshot_date", F.get(date_array(dates), F.col("_index"))).drop("_from", "_to", "_index")
