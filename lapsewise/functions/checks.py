"""Data-contract checks: required columns, unique keys, ranges, forbidden columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {missing}")


def forbid_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> None:
    found = sorted(set(names) & set(df.columns))
    if found:
        raise ValueError(f"{what} must not contain future-only columns: {found}")


def require_positive(**values) -> None:
    for name, value in values.items():
        numbers = value if isinstance(value, (list, tuple)) else [value]
        if not numbers or any(number <= 0 for number in numbers):
            raise ValueError(f"{name} must be positive")


def require_fractions(values: Sequence[float], name: str, closed_above: bool = True) -> None:
    for value in values:
        if value <= 0 or value > 1 or (value == 1 and not closed_above):
            raise ValueError(f"{name} must lie between 0 and 1")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def require_unique(df: DataFrame, keys: Sequence[str], what: str = "table") -> None:
    examples = duplicate_keys(df, keys).limit(5).collect()
    if examples:
        raise ValueError(f"{what} must hold one row per {list(keys)}; repeated: {[r.asDict() for r in examples]}")


def violations(df: DataFrame, rules: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows breaking each rule, counted in one pass. A rule is true for good rows; null breaks it."""
    counted = [
        F.coalesce(F.sum(F.when(F.coalesce(rule, F.lit(False)), 0).otherwise(1)), F.lit(0)).cast("bigint").alias(name)
        for name, rule in rules.items()
    ]
    return df.groupBy(*by).agg(*counted)


def require_rules(df: DataFrame, rules: Mapping[str, Column], what: str = "table") -> None:
    broken = {name: n for name, n in violations(df, rules).first().asDict().items() if n}
    if broken:
        raise ValueError(f"{what} breaks its contract: {broken}")


def require_covered(left: DataFrame, right: DataFrame, keys: Sequence[str], what: str) -> None:
    """Fail with examples when a key of `left` has no row in `right`."""
    examples = left.join(right, list(keys), "left_anti").select(*keys).limit(5).collect()
    if examples:
        raise ValueError(f"{what}: {[r.asDict() for r in examples]}")


def training_rules(max_window: int = 180) -> dict[str, Column]:
    return {
        "recency_out_of_range": F.col("recency").between(1, max_window),
        f"monetary_{max_window}d_negative": F.col(f"monetary_{max_window}d") >= 0,
        f"orders_{max_window}d_missing": F.col(f"orders_{max_window}d") >= 1,
        "churn_not_binary": F.col("churn").isin(0, 1),
    }


def window_rules(windows: Sequence[int]) -> dict[str, Column]:
    """Longer windows hold at least as much; gaps are null exactly without repeat history."""
    rules = {}
    ordered = sorted(windows)
    for name in ("purchase_days", "orders", "monetary", "units"):
        for short, wide in zip(ordered, ordered[1:]):
            rules[f"{name}_{wide}d_below_{short}d"] = F.col(f"{name}_{wide}d") >= F.col(f"{name}_{short}d")
    for gap in ("median_purchase_gap", "latest_purchase_gap", "purchase_gap_std"):
        rules[f"{gap}_presence"] = F.col(gap).isNull() == (F.col("has_repeat_purchase_history") == 0)
    return rules


def split_valid(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Attach `problems`, the list of contract breaches of each prepared feature row."""
    require_columns(df, features, "feature rows")
    extra = sorted(set(df.columns) - set(features) - {"customer_id", "snapshot_date"})
    if extra:
        raise ValueError(f"feature rows carry unexpected columns: {extra}")
    signed = {"order_change_90d", "monetary_change_90d"}
    nullable = {"median_purchase_gap", "latest_purchase_gap", "purchase_gap_std"}
    checks = []
    for name in features:
        value = F.col(name)
        if name not in nullable:
            checks.append(F.when(value.isNull(), F.lit(f"{name}: missing")))
        if name == "snapshot_month":
            checks.append(F.when(~value.between(1, 12), F.lit(f"{name}: not a month")))
        elif name == "has_repeat_purchase_history":
            checks.append(F.when(~value.isin(0, 1), F.lit(f"{name}: not 0 or 1")))
        elif name not in signed:
            checks.append(F.when(value < 0, F.lit(f"{name}: negative")))
    return df.withColumn("problems", F.array_compact(F.array(*checks)))
