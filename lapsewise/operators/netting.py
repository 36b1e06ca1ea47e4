"""Net cancellations against earlier sales without keeping any state.

Within a group in time order, with signed quantity q:

    P = running sum of q                 S = running sum of the sold units
    stock = P - min(0, running min of P)     units on hand; a cancellation with
                                             nothing left to consume has no effect
    used = S - stock                         units consumed so far

Units carry positions: a sale owns (S - q, S]. First-in-first-out consumption uses
positions in order, so `used` alone says which units are gone at any moment. Newest-first
consumption keeps of a sale what the lowest later stock level still covers.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from lapsewise.operators.cleaning import cancelled_units, sold_units
from lapsewise.operators.folds import Fold, RowFold, ordered_fold
from lapsewise.operators.scans import Scan, hot_groups, lag, lead, ordered_scan, prefix, spread, suffix, total
from lapsewise.session import part_of, written

KEYS = ("customer_id", "stock_code")
ORDER = ("invoice_date", "row_seq")


def _stock(scan: Scan) -> Scan:
    scan = scan.add(_run=prefix("sum", "quantity"), _sold=prefix("sum", sold_units(F.col("quantity"))))
    scan = scan.add(_low=prefix("min", "_run"))
    return scan.with_columns(_stock=F.col("_run") - F.least(F.lit(0.0), F.col("_low")))


def _used(scan: Scan) -> Scan:
    return _stock(scan).with_columns(_used=F.col("_sold") - F.col("_stock"))


def _kept(scan: Scan, quantity) -> DataFrame:
    remaining = F.when(F.col("quantity") > 0, F.greatest(F.lit(0.0), F.least(F.col("quantity"), quantity)))
    return scan.df.withColumn("remaining_quantity", F.coalesce(remaining, F.lit(0.0)))


def net_oldest_first(lines: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Attach `remaining_quantity`; cancellations consume the oldest open units."""

    def run(scan: Scan) -> DataFrame:
        scan = _used(scan).add(_all_used=total("max", "_used"))
        return _kept(scan, F.col("_sold") - F.col("_all_used")).select(*lines.columns, "remaining_quantity")

    return ordered_scan(lines, KEYS, order, run)


def net_newest_at_price(lines: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Attach `remaining_quantity`; cancellations consume the newest open units of equal price."""

    def run(scan: Scan) -> DataFrame:
        scan = _stock(scan).add(_floor=suffix("min", "_stock"))
        return _kept(scan, F.col("_floor") - (F.col("_stock") - F.col("quantity"))).select(
            *lines.columns, "remaining_quantity"
        )

    priced = part_of(lines, lines.filter(F.col("price").isNotNull()))
    netted = ordered_scan(priced, (*KEYS, "price"), order, run)
    # A missing price equals no price: such sales stay whole and such cancellations match nothing.
    if "price" in lines.columns and lines.schema["price"].nullable:
        unpriced = lines.filter(F.col("price").isNull()).withColumn("remaining_quantity", sold_units(F.col("quantity")))
        return netted.unionByName(unpriced)
    return netted


def net_with(function: Callable[[pd.DataFrame], pd.Series], lines: DataFrame) -> DataFrame:
    """A caller's own policy: `function` gets one whole (customer, item) group and returns what remains per row.

    A group is one pandas frame in one task, whatever its size. For groups of any size a policy is written
    as ordered scans (`net_by_scan`) or as a Python fold (`net_by_fold`).
    """
    schema = T.StructType([*lines.schema.fields, T.StructField("remaining_quantity", T.DoubleType())])

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        return group.assign(remaining_quantity=function(group).reindex(group.index).astype(float))

    return lines.groupBy(*KEYS).applyInPandas(apply, schema)


def net_by_scan(
    remaining: Callable[[Scan], Scan], lines: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER
) -> DataFrame:
    """A caller's own policy as steps of an ordered scan, for groups of any size.

    `remaining` adds columns to the scan it gets, among them `remaining_quantity`.
    """
    return ordered_scan(
        lines, keys, order, lambda scan: remaining(scan).df.select(*lines.columns, "remaining_quantity")
    )


def net_by_fold(fold: Fold | RowFold, lines: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """A caller's own policy as a Python fold over the lines in order; its last pass gives what remains per row."""
    found = ordered_fold(lines, keys, order, fold, "remaining_quantity", "double")
    return found.withColumn("remaining_quantity", F.coalesce("remaining_quantity", F.lit(0.0)))


def _count_used(state, row: tuple, earlier):
    """Running stock, its lowest point, and units sold: what a group's cancellations consume in all."""
    run, low, sold = state or (0.0, 0.0, 0.0)
    quantity = row[0] or 0.0
    run += quantity
    return (run, min(low, run), sold + max(quantity, 0.0)), None


def _keep_unused(state, row: tuple, earlier):
    """Oldest units go first: a sale keeps what lies beyond the units used."""
    run, low, sold = earlier
    units = max(row[0] or 0.0, 0.0)
    upto = (state or 0.0) + units
    return upto, max(0.0, min(units, upto - (sold - (run - min(0.0, low)))))


# First in, first out, as a caller would write it.
OLDEST_FIRST = RowFold(("quantity",), (_count_used, _keep_unused))

POLICIES = {"fifo": net_oldest_first, "price_compatible": net_newest_at_price}


def net_purchases(lines: DataFrame, policy="fifo", order: Sequence[str] = ORDER) -> DataFrame:
    """Sales that survive netting, with `remaining_quantity` and `net_revenue`."""
    if isinstance(policy, (Fold, RowFold)):
        netted = net_by_fold(policy, lines, order=order)
    elif callable(policy):
        netted = net_with(policy, lines)
    elif policy in POLICIES:
        netted = POLICIES[policy](lines, order)
    else:
        raise ValueError(f"policy must be a fold, a function or one of {sorted(POLICIES)}")
    return netted.filter("remaining_quantity > 0").withColumn(
        "net_revenue", F.col("remaining_quantity") * F.col("price")
    )


def lot_lifetimes(lines: DataFrame, order: Sequence[str] = ORDER, keep: Sequence[str] = ()) -> DataFrame:
    """Every sold unit with the day it was sold and the day it was cancelled, oldest units first.

    One row per stretch of units of one sale with one fate: `open_day`, `close_day`
    (null when never cancelled), `units`. The first-in-first-out state before a snapshot T is
    `open_day < T and (close_day is null or close_day >= T)`, for every T at once; later
    cancellations cannot reach an earlier T because they only ever set a later `close_day`.

    Sales cut the line of unit positions where they start; cancellations cut it where the
    units they consume start. One ordered scan over the cuts yields the stretches, so the
    output has at most one row per sale plus one per cancellation. `keep` names further columns
    of the sales that their stretches carry.
    """

    def run(scan: Scan) -> DataFrame:
        scan = _used(scan).add(_before=lag("_used"), _all_used=total("max", "_used"), _end=total("max", "_sold"))
        day = F.to_date("invoice_date")
        sale = F.struct("invoice", day.alias("open_day"), F.col("price"), *keep)
        no_sale = F.lit(None).cast(T.StructType([
            T.StructField("invoice", T.StringType()), T.StructField("open_day", T.DateType()),
            T.StructField("price", T.DoubleType()), *[T.StructField(c, lines.schema[c].dataType) for c in keep],
        ]))
        closing = F.struct(day.alias("close_day"))
        never = F.struct(F.lit(None).cast("date").alias("close_day"))
        no_closing = F.lit(None).cast(T.StructType([T.StructField("close_day", T.DateType())]))

        def cut(at, rank, lot, fate):
            return F.struct(at.alias("at"), F.lit(rank).alias("rank"), lot.alias("lot"), fate.alias("fate"))

        before = F.coalesce("_before", F.lit(0.0))
        cuts = F.when(
            F.col("quantity") > 0,
            F.array(cut(F.col("_sold") - F.col("quantity"), 2, sale, no_closing)),
        ).when(
            F.col("_used") > before,
            F.when(
                F.col("_used") < F.col("_all_used"), F.array(cut(before, 1, no_sale, closing))
            ).otherwise(
                F.array(cut(before, 1, no_sale, closing), cut(F.col("_used"), 0, no_sale, never))
            ),
        )
        lines_cut = scan.df.select(*KEYS, "_end", F.explode(cuts).alias("_cut")).select(*KEYS, "_end", "_cut.*")
        scan = scan.reordered(lines_cut, "at", "rank").add(
            lot_now=prefix("last", "lot"), fate_now=prefix("last", "fate"), until=lead("at")
        )
        units = F.coalesce("until", "_end") - F.col("at")
        return (
            scan.df.select(*KEYS, "lot_now.*", "fate_now.close_day", units.alias("units"))
            .filter("units > 0")
        )

    used = {*KEYS, "invoice", "quantity", "price", "invoice_date", *keep}
    read = lines
    if all(isinstance(c, str) for c in order):
        # Only what the scan reads is written and moved.
        read = lines.select(*[c for c in lines.columns if c in used | set(order)])
    return ordered_scan(part_of(lines, read.filter("quantity <> 0")), KEYS, order, run)


def open_lots(lines: DataFrame, snapshots, order: Sequence[str] = ORDER, lots: DataFrame | None = None) -> DataFrame:
    """Open units per sale at each snapshot date, from events strictly before it.

    `lots` may pass sale lifetimes computed (and written) before; they must come from `lines`.
    """
    from lapsewise.operators.snapshots import at_open_snapshots

    if lots is None:
        lots = lot_lifetimes(lines, order)
    elif hot_groups(lots := written(lots), KEYS) is None:
        # Dealt before they repeat, so that what repeats is summed where it is made.
        lots = spread(lots, KEYS)
    lots = at_open_snapshots(lots, snapshots, "open_day", "close_day")
    return lots.groupBy("snapshot_date", *KEYS, "invoice", "open_day", "price").agg(
        F.sum("units").alias("remaining_quantity")
    ).withColumn("net_revenue", F.col("remaining_quantity") * F.col("price"))
