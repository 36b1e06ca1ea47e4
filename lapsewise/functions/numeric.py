"""Exact statistics that stay distributed, and small numeric expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.operators.scans import ordered_scan, prefix
from lapsewise.session import GROUP_ROWS, materialise, setting, written

ACCURACY = 10_000  # of the sketches that bound a quantile


def ratio(top, bottom) -> Column:
    """top / bottom, null when the bottom is zero or null."""
    return F.try_divide(_num(top), _num(bottom))


def beside(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table (an aggregate without groups) as a scalar subquery, without a join."""
    row = one_row.select(F.struct(*one_row.columns).alias("r")).scalar()
    return df.withColumn("_one", row).select("*", "_one.*").drop("_one")


def whole_days(start: Column, end: Column) -> Column:
    """Whole 24-hour periods between two instants, exact to the microsecond."""
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86_400_000_000)).cast("int")


def at_most(value: Column, limit: Column) -> Column:
    """The smaller of the two; missing where the value is missing (`least` would take the limit)."""
    return F.when(value > limit, limit).otherwise(value)


def _num(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("double")


def binned(value: Column, bins: Sequence[tuple]) -> Column:
    """Label of the first bin whose inclusive upper bound covers the value."""
    label = None
    for upper, name in bins:
        if upper is None:
            return label.otherwise(F.when(value.isNotNull(), F.lit(name)))
        label = F.when(value <= upper, name) if label is None else label.when(value <= upper, name)
    return label


def bin_order(value: Column, bins: Sequence[tuple]) -> Column:
    return binned(value, [(upper, i) for i, (upper, _) in enumerate(bins)])


def lookup(key: Column, mapping: Mapping) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*pairs)[key]


def quantile_table(
    df: DataFrame, wanted: Mapping[str, tuple[str, float]], by: Sequence[str] = ()
) -> DataFrame:
    """Exact, linearly interpolated quantiles of several columns: one row per group, one column per name.

    `wanted` maps output names to (column, quantile). The built-in aggregate keeps every distinct
    value of a group in one buffer. That is used only where the values of the (written) input
    are no more than one task may hold; beyond it, sketches bound the two values around each quantile, one pass counts
    the values below and moves only those within the bounds, and these are ranked exactly.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    df = written(df.select(*dict.fromkeys([*by, *columns])))
    if df.count() * len(columns) <= setting(df.sparkSession, GROUP_ROWS):
        return df.groupBy(*by).agg(*[
            F.percentile(F.col(c).cast("double"), q).alias(name) for name, (c, q) in wanted.items()
        ])
    value = {c: F.col(c).cast("double") for c in columns}
    names = list(wanted)
    of = [(columns.index(c), float(q)) for c, q in wanted.values()]
    # Ranks of a sketch are off by about n / ACCURACY; the bounds leave five times that on either side.
    slack = 5 / ACCURACY
    asked = [[min(1.0, max(0.0, q + e)) for e in (-slack, slack)] for _, q in of]
    rough = df.groupBy(*by).agg(
        *[F.count(value[c]).alias(f"_n{i}") for i, c in enumerate(columns)],
        *[F.min(value[c]).alias(f"_low{i}") for i, c in enumerate(columns)],
        *[F.max(value[c]).alias(f"_high{i}") for i, c in enumerate(columns)],
        *[F.percentile_approx(value[columns[i]], both, ACCURACY).alias(f"_b{j}") for j, ((i, _), both) in enumerate(zip(of, asked))],
    )
    # At the ends, and in groups so small that the slack is no whole rank, the bounds are the extremes themselves.
    bounds = materialise(rough.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.array(*[
        F.struct(
            F.col(f"_n{i}").alias("n"),
            F.when((F.lit(both[0]) <= 0) | (F.col(f"_n{i}") <= ACCURACY), F.col(f"_low{i}")).otherwise(F.col(f"_b{j}")[0]).alias("low"),
            F.when((F.lit(both[1]) >= 1) | (F.col(f"_n{i}") <= ACCURACY), F.col(f"_high{i}")).otherwise(F.col(f"_b{j}")[1]).alias("high"),
        ) for j, ((i, _), both) in enumerate(zip(of, asked))
    ]).alias("_bounds")))
    if by:
        same = F.lit(True)
        for c in by:
            same &= df[c].eqNullSafe(bounds[f"_of_{c}"])
        rows = df.join(bounds, same)
        bound = lambda j, part: F.col("_bounds")[j][part]
    else:
        rows, held = df, bounds.first()[0]  # one row
        bound = lambda j, part: F.lit(held[j][part]).cast("bigint" if part == "n" else "double")
    inside = lambda j, v: v.between(bound(j, "low"), bound(j, "high"))
    below = rows.groupBy(*by).agg(
        *[F.count(F.when(value[columns[i]] < bound(j, "low"), 1)).alias(f"_below{j}") for j, (i, _) in enumerate(of)],
        *[F.first(bound(j, "n")).alias(f"_n{j}") for j in range(len(of))],
    )
    cells = F.array_compact(F.array(*[
        F.when(inside(j, value[columns[i]]), F.struct(F.lit(j).alias("_j"), value[columns[i]].alias("_v"))) for j, (i, _) in enumerate(of)
    ]))
    counted = rows.select(*by, F.explode(cells).alias("_x")).groupBy(*by, "_x._j", "_x._v").agg(F.count(F.lit(1)).alias("_copies"))
    upto = ordered_scan(counted, [*by, "_j"], ["_v"], lambda scan: scan.add(_upto=prefix("sum", "_copies")).df)
    places = F.array(*[
        F.struct(F.lit(j).alias("_j"), F.col(f"_below{j}").alias("_below"), (F.lit(q) * (F.col(f"_n{j}") - 1)).alias("_at")) for j, (_, q) in enumerate(of)
    ])
    # One row per group and quantile.
    sought = below.select(*[F.col(c).alias(f"_of_{c}") for c in by], F.explode(places).alias("_p")).select(*[f"_of_{c}" for c in by], "_p.*")
    sought = sought.withColumnRenamed("_j", "_k")
    same = F.col("_j") == F.col("_k")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    rank, place = F.col("_upto") + F.col("_below"), F.col("_at")
    low, high = F.floor(place), F.ceil(place)

    def at(j: int, spot: Column) -> Column:
        here = (F.col("_k") == j) & (rank > spot) & (rank - F.col("_copies") <= spot)
        return F.max(F.when(here, F.col("_v")))

    found = []
    for j, name in enumerate(names):
        share = F.max(F.when(F.col("_k") == j, place - low))
        found.append((at(j, low) * (1 - share) + at(j, high) * share).alias(name))
    # From the side of the groups, so that a group without values keeps its row.
    joined = sought.join(upto, same, "left").select(*[F.col(f"_of_{c}").alias(c) for c in by], "_k", "_below", "_at", "_v", "_upto", "_copies")
    return joined.groupBy(*by).agg(*found)


def exact_quantiles(
    df: DataFrame, value: str, quantiles: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """`quantile_table` for one column."""
    return quantile_table(df, {name: (value, q) for name, q in quantiles.items()}, by)


def sample_skewness(column: str) -> Column:
    """Bias-corrected skewness; Spark's own is the population one."""
    n = F.count(column)
    return F.when(n > 2, F.skewness(column) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0)))


def wilson(successes: Column, observations: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of the Wilson interval of a proportion."""
    n = F.nullif(observations.cast("double"), F.lit(0.0))
    p = successes / n
    scale = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / scale
    margin = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / scale
    return centre - margin, centre + margin


def bigint(column: Column) -> Column:
    return column.cast("bigint")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))
