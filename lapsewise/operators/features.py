"""As-of customer features at historical snapshots, for all snapshots in one plan.

Everything derives from sale lifetimes (`netting.lot_lifetimes`): units are open at a snapshot T
when sold before T and not cancelled before T, so nothing recorded from T on can reach T.
Four branches are computed per (customer, snapshot) and brought together:

- recent days:   recency and day counts                 (days repeat per snapshot within reach)
- recent orders: windowed orders, value and units       (orders repeat per snapshot within reach)
- lifetime:      running totals and cadence states      (rows repeat only where something changes)
- cancellations: windowed activity by day

What comes in is dealt by customer once, and rows repeat only behind that: the branches, their sums and their meeting all
take place where the customer's rows are, so nothing that was repeated is moved or written to disk.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapsewise.functions import fixed
from lapsewise.functions.checks import require_columns, require_covered, require_positive, require_unique
from lapsewise.functions.numeric import count_if, ratio
from lapsewise.operators.cleaning import LINE_COLUMNS, cancelled_units, sold_units
from lapsewise.operators.labels import recent_snapshots
from lapsewise.operators.netting import ORDER, lot_lifetimes
from lapsewise.operators.scans import parts_for
from lapsewise.operators.snapshots import as_dates, date_array, with_passed
from lapsewise.session import written

AT = ["customer_id", "_index"]


def feature_columns(windows: Sequence[int] = fixed.FEATURE_WINDOWS) -> list[str]:
    """The model features, in contract order."""
    longest = max(windows)
    return [
        "recency", "tenure_days", "lifetime_purchase_days", "lifetime_orders", "lifetime_monetary", "lifetime_units",
        "lifetime_unique_products", "average_order_value",
        *[f"{name}_{w}d" for w in windows for name in ("purchase_days", "orders", "monetary", "units")],
        "orders_previous_90d", "monetary_previous_90d", "purchase_days_previous_90d",
        "order_change_90d", "monetary_change_90d", "order_trend_ratio_90d", "monetary_trend_ratio_90d",
        "median_purchase_gap", "latest_purchase_gap", "purchase_gap_std", "has_repeat_purchase_history",
        *[f"{name}_{longest}d" for name in (
            "cancellation_rows", "cancelled_units", "cancellation_value", "positive_units", "cancellation_unit_rate",
        )],
        "snapshot_month",
    ]


def _at_all_open(df: DataFrame) -> DataFrame:
    return df.withColumn("_index", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)))


def _age(day: str, dates: Sequence[date]) -> Column:
    return F.datediff(F.get(date_array(dates), F.col("_index")), F.col(day))


def _recent_day_features(days: DataFrame, dates: list[date], windows: Sequence[int]) -> DataFrame:
    """Recency and day counts per window; only customers eligible at the snapshot get a row."""
    age = F.col("_age")
    return _recent(days, dates, max(windows)).groupBy(*AT).agg(
        F.min(age).alias("recency"),
        *[count_if(age <= w).alias(f"purchase_days_{w}d") for w in windows],
        count_if(age.between(91, 180)).alias("purchase_days_previous_90d"),
    )


def _cadence_states(days: DataFrame, last: int) -> DataFrame:
    """First day, day count and gap statistics of a customer's open days, whenever they change.

    The set of open days only changes at snapshots where a day opens or closes, so it is built
    there and not at every snapshot. Rows come spread by customer; a customer has at most one
    row per calendar day, which bounds the windows and the arrays.
    """
    own = W.partitionBy("customer_id")
    changes = F.array_union(F.collect_set("_from").over(own), F.collect_set("_to").over(own))
    standing = F.filter("_changes", lambda i: (i >= F.col("_from")) & (i < F.col("_to")))
    seen = days.withColumn("_changes", changes).select(
        "customer_id", "open_day", F.explode(standing).alias("_index")
    )
    previous = F.lag("open_day").over(W.partitionBy(*AT).orderBy("open_day"))
    seen = seen.withColumn("_gap", F.datediff("open_day", previous).cast("double"))
    # The median is the mean of the one or two middle gaps; both windows reuse the partitioning.
    by_gap = W.partitionBy(*AT).orderBy(F.col("_gap").asc_nulls_last())
    placed = seen.withColumns({
        "_place": F.row_number().over(by_gap) - 1, "_gaps": F.count("_gap").over(W.partitionBy(*AT)),
    })
    middle = F.abs(2 * F.col("_place") - (F.col("_gaps") - 1)) <= 1
    return placed.groupBy(*AT).agg(
        F.min("open_day").alias("first_day"),
        F.count(F.lit(1)).alias("open_days"),
        F.avg(F.when(middle, F.col("_gap"))).alias("median_gap"),
        F.max_by("_gap", "open_day").alias("latest_gap"),
        F.stddev_pop("_gap").alias("gap_std"),
    )


def _recent(df: DataFrame, dates: list[date], longest: int) -> DataFrame:
    """Repeat rows for the snapshots at which they are open and at most `longest` days old; adds `_age`."""
    reached = with_passed(df.withColumn("_until", F.date_add("open_day", longest)), dates, "_until", "_reach")
    end = F.least(F.col("_to"), F.col("_reach"))
    return reached.filter(F.col("_from") < end).withColumn(
        "_index", F.explode(F.sequence(F.col("_from"), end - 1))
    ).withColumn("_age", _age("open_day", dates))


def _recent_order_features(orders: DataFrame, dates: list[date], windows: Sequence[int]) -> DataFrame:
    """Distinct orders, value and units within each window: one row per order first, then per customer."""
    recent = _recent(orders, dates, max(windows))
    age = F.col("_age")
    previous = age.between(91, 180)

    def within(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)))

    per_order = recent.groupBy(*AT, "invoice").agg(
        F.min(age).alias("_newest"),
        F.max(previous.cast("int")).alias("_previous"),
        *[within(age <= w, v).alias(f"{v}_{w}d") for w in windows for v in ("monetary", "units")],
        within(previous, "monetary").alias("monetary_previous_90d"),
    )
    sums = [f"{v}_{w}d" for w in windows for v in ("monetary", "units")] + ["monetary_previous_90d"]
    return per_order.groupBy(*AT).agg(
        *[count_if(F.col("_newest") <= w).alias(f"orders_{w}d") for w in windows],
        F.sum("_previous").alias("orders_previous_90d"),
        *[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in sums],
    )


def _cover(df: DataFrame, keys: list[str], name: str, last: int) -> DataFrame:
    """+1 where an entity becomes open and -1 where it closes, over the union of its open spells."""
    spells = df.groupBy(*keys, "_from").agg(F.max("_to").alias("_to"))
    earlier = W.partitionBy(*keys).orderBy("_from").rowsBetween(W.unboundedPreceding, -1)
    start = F.greatest(F.col("_from"), F.max("_to").over(earlier))
    fresh = spells.withColumn("_start", start).filter(F.col("_start") < F.col("_to"))
    steps = F.array(
        F.struct(F.col("_start").alias("_index"), F.lit(1).alias(name)),
        F.struct(F.col("_to").alias("_index"), F.lit(-1).alias(name)),
    )
    return fresh.select("customer_id", F.explode(steps).alias("_s")).select("customer_id", "_s.*").filter(
        F.col("_index") < last
    )


def _lifetime_features(lots: DataFrame, orders: DataFrame, days: DataFrame, wanted: DataFrame, dates: list[date]) -> DataFrame:
    """Lifetime totals and cadence, carried along the snapshot index of each customer, beside the columns of `wanted`.

    Units never cancelled count from their first snapshot on; units cancelled later count at
    each snapshot in between, so no value is ever added and subtracted again.
    """
    last = len(dates)
    kept = orders.filter(F.col("_to") == last).select(
        "customer_id", F.col("_from").alias("_index"), F.col("units").alias("kept_units"),
        F.col("monetary").alias("kept_value"),
    )
    passing = _at_all_open(orders.filter(F.col("_to") < last)).select(
        *AT, F.col("units").alias("passing_units"), F.col("monetary").alias("passing_value")
    )
    changes = (
        wanted.withColumn("wanted", F.lit(1))
        .unionByName(kept, allowMissingColumns=True)
        .unionByName(passing, allowMissingColumns=True)
        .unionByName(_cover(orders, ["customer_id", "invoice"], "order_steps", last), allowMissingColumns=True)
        .unionByName(_cover(lots, ["customer_id", "stock_code"], "product_steps", last), allowMissingColumns=True)
        .unionByName(_cadence_states(days, last), allowMissingColumns=True)
    )
    state = ["first_day", "open_days", "median_gap", "latest_gap", "gap_std"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (
        "wanted", "kept_units", "kept_value", "passing_units", "passing_value", "order_steps", "product_steps",
    )]
    # At most one row per customer and index is wanted, and one carries a state.
    carried = [c for c in wanted.columns if c not in AT]
    at = changes.groupBy(*AT).agg(*sums, *[F.max(c).alias(c) for c in [*state, *carried]])
    run = W.partitionBy("customer_id").orderBy("_index").rowsBetween(W.unboundedPreceding, 0)
    at = at.withColumn("_state", F.when(F.col("open_days").isNotNull(), F.struct(*state))).drop(*state)
    totals = at.select(
        *AT, "wanted", *carried,
        F.sum("order_steps").over(run).alias("lifetime_orders"),
        (F.sum("kept_value").over(run) + F.col("passing_value")).alias("lifetime_monetary"),
        (F.sum("kept_units").over(run) + F.col("passing_units")).alias("lifetime_units"),
        F.sum("product_steps").over(run).alias("lifetime_unique_products"),
        F.last("_state", ignorenulls=True).over(run).alias("_state"),
    )
    return totals.filter("wanted = 1").withColumns({
        "average_order_value": ratio("lifetime_monetary", "lifetime_orders"),
        "tenure_days": _age("_state.first_day", dates),
        "lifetime_purchase_days": F.col("_state.open_days"),
        "median_purchase_gap": F.col("_state.median_gap"),
        "latest_purchase_gap": F.col("_state.latest_gap"),
        "purchase_gap_std": F.col("_state.gap_std"),
    }).drop("wanted", "_state")


def _cancellation_features(lines: DataFrame, dates: list[date], longest: int, parts: int) -> DataFrame:
    quantity = F.col("quantity")
    # Dealt before they are summed: the engine sizes the parts of a sum by packed bytes.
    dealt = lines.select("customer_id", F.to_date("invoice_date").alias("_day"), "quantity", "price").repartition(
        parts, "customer_id"
    )
    daily = dealt.groupBy("customer_id", "_day").agg(
        count_if(quantity < 0).alias("rows"),
        F.sum(cancelled_units(quantity)).alias("cancelled"),
        F.sum(cancelled_units(quantity) * F.col("price")).alias("value"),
        F.sum(sold_units(quantity)).alias("positive"),
    )
    return recent_snapshots(daily, dates, "_day", longest).groupBy(*AT).agg(
        F.sum("rows").alias(f"cancellation_rows_{longest}d"),
        F.sum("cancelled").alias(f"cancelled_units_{longest}d"),
        F.coalesce(F.sum("value"), F.lit(0.0)).alias(f"cancellation_value_{longest}d"),
        F.sum("positive").alias(f"positive_units_{longest}d"),
    )


def snapshot_features(
    lines: DataFrame,
    snapshots: Sequence,
    windows: Sequence[int] = fixed.FEATURE_WINDOWS,
    lots: DataFrame | None = None,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Features per customer and snapshot, for customers with an open purchase within the longest window.

    `lots` may pass sale lifetimes computed (and written) before; they must come from `lines`.
    """
    return _indexed_features(lines, snapshots, windows, lots, order).select(
        "customer_id", "snapshot_date", *feature_columns(windows), "snapshot_quarter", "is_holiday_season"
    )


def _unpruned(df: DataFrame) -> DataFrame:
    """Every branch that reads `df` asks for all its columns, so that the shuffle below is one and the same for all."""
    # True for every row, and as it cannot be known before, it stays above the shuffle.
    return df.filter((F.sqrt(F.rand(0)) < 2) | (F.xxhash64(*df.columns) == 0))


def _together(branches: Sequence[DataFrame]) -> DataFrame:
    """Rows of one customer and index side by side: `_0`, `_1`, ... hold a branch's columns, null where it has no row.

    Each branch has at most one row per customer and index and is dealt by customer; such a union stays where it is,
    while a join would deal its sides anew.
    """
    rows = None
    for i, branch in enumerate(branches):
        packed = branch.select(*AT, F.struct(*[c for c in branch.columns if c not in AT]).alias(f"_{i}"))
        rows = packed if rows is None else rows.unionByName(packed, allowMissingColumns=True)
    return rows.groupBy(*AT).agg(*[F.first(f"_{i}", ignorenulls=True).alias(f"_{i}") for i in range(len(branches))])


def _indexed_features(
    lines: DataFrame, snapshots: Sequence, windows: Sequence[int], lots: DataFrame | None, order: Sequence[str],
    target: DataFrame | None = None,
) -> DataFrame:
    """The features by customer and snapshot index, once for each row of `target` where it is given, with its columns."""
    require_columns(lines, LINE_COLUMNS, "sales lines")
    require_positive(windows=list(windows))
    if not {90, 180} <= set(windows):
        raise ValueError("windows must include 90 and 180 days for the trend features")
    dates = as_dates(snapshots)
    windows, longest = list(windows), max(windows)
    lots = written(lot_lifetimes(lines, order) if lots is None else lots)
    # Rows repeat per snapshot after they moved, so the parts follow the rows, not the packed bytes of what moves.
    parts = max(parts_for(lots.sparkSession, 2 * lots.count()), int(lots.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    used = ("customer_id", "stock_code", "invoice", "open_day", "close_day", "price", "units")
    dealt = _unpruned(lots.select(*used).repartition(parts, "customer_id"))
    lots = with_passed(with_passed(dealt, dates, "open_day", "_from"), dates, "close_day", "_to").filter(
        F.col("_from") < F.col("_to")
    )
    orders = lots.groupBy("customer_id", "invoice", "open_day", "_from", "_to").agg(
        F.sum("units").alias("units"), F.sum(F.col("units") * F.col("price")).alias("monetary")
    )
    days = orders.groupBy("customer_id", "open_day").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    branches = [
        _lifetime_features(lots, orders, days, _recent_day_features(days, dates, windows), dates),
        _recent_order_features(orders, dates, windows), _cancellation_features(lines, dates, longest, parts),
    ]
    if target is not None:
        row = F.struct(*[c for c in target.columns if c not in AT])
        branches.append(target.repartition(parts, "customer_id").groupBy(*AT).agg(F.collect_list(row).alias("rows")))
    # Only customers who bought lately have the first two.
    table = _together(branches).filter("customer_id is not null and _0 is not null and _1 is not null")
    more = []
    if target is not None:
        table, more = table.withColumn("_row", F.explode("_3.rows")), ["_row"]
    table = table.select(*AT, *more, "_0.*", "_1.*", "_2.*")
    cancelled = [f"{n}_{longest}d" for n in (
        "cancellation_rows", "cancelled_units", "cancellation_value", "positive_units",
    )]
    table = table.fillna(0, cancelled).withColumns({
        "order_change_90d": F.col("orders_90d") - F.col("orders_previous_90d"),
        "monetary_change_90d": F.col("monetary_90d") - F.col("monetary_previous_90d"),
        "order_trend_ratio_90d": (F.col("orders_90d") + 1) / (F.col("orders_previous_90d") + 1),
        "monetary_trend_ratio_90d": (F.col("monetary_90d") + 1) / (F.col("monetary_previous_90d") + 1),
        "has_repeat_purchase_history": (F.col("lifetime_purchase_days") >= 2).cast("int"),
        f"cancellation_unit_rate_{longest}d": F.coalesce(
            ratio(f"cancelled_units_{longest}d", f"positive_units_{longest}d"), F.lit(0.0)
        ),
        "snapshot_date": F.get(date_array(dates), F.col("_index")),
    }).withColumns({
        "snapshot_month": F.month("snapshot_date"),
        "snapshot_quarter": F.quarter("snapshot_date"),
        "is_holiday_season": F.month("snapshot_date").isin(10, 11, 12).cast("int"),
    })
    return table.select(
        *AT, *more, "snapshot_date", *feature_columns(windows), "snapshot_quarter", "is_holiday_season"
    )


def training_table(
    lines: DataFrame,
    labels: DataFrame,
    windows: Sequence[int] = fixed.FEATURE_WINDOWS,
    lots: DataFrame | None = None,
    snapshots: Sequence | None = None,
    check: bool = True,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Labels joined with the features known at each snapshot.

    `check` verifies, with two extra jobs, that label keys are unique and all have features.
    """
    require_columns(labels, ["customer_id", "snapshot_date", "churn"], "labels")
    keys = ["customer_id", "snapshot_date"]
    target = labels.select(*keys, "churn")
    if snapshots is None:
        snapshots = [r.snapshot_date for r in target.select("snapshot_date").distinct().collect()]
    dates = as_dates(snapshots)
    if check:
        features = _indexed_features(lines, dates, windows, lots, order)
        require_unique(target, keys, "labels")
        require_covered(target, features, keys, "labelled rows without features")
    # The snapshot index takes the labels to the features; the wide rows stay where they are.
    indexed = with_passed(target, dates, "snapshot_date", "_passed").withColumn("_index", F.col("_passed") - 1).drop("_passed")
    indexed = indexed.select(*AT, "snapshot_date", "churn")
    rows = _indexed_features(lines, dates, windows, lots, order, indexed)
    return rows.select("customer_id", "_row.snapshot_date", "_row.churn", *rows.columns[4:])
