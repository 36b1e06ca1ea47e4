"""Classification and ranking metrics, computed per group (fold, candidate, ...) in Spark.

Inputs carry `churn` (0/1) and a score. Rank metrics first collapse rows to distinct scores,
so cumulative sums run over scores instead of rows; selections by rank use ordered scans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.functions import fixed
from lapsewise.functions.checks import require_fractions, require_positive
from lapsewise.functions.numeric import beside, count_if, exact_quantiles, ratio
from lapsewise.operators.scans import ordered_scan, position, prefix, total


def ranked(df: DataFrame, score: str, by: Sequence[str] = (), tie: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Attach `rank` (1 = highest score, ties by `tie`) and `group_rows`."""

    def run(scan):
        return scan.add(rank=position(), group_rows=total("sum", F.lit(1).cast("bigint"))).df

    return ordered_scan(df, list(by), [F.col(score).desc(), *tie], run)


def top_count(rows: Column, fraction) -> Column:
    """Size of the top fraction: at least one row."""
    share = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return F.greatest(F.lit(1), F.ceil(rows * share)).cast("bigint")


def recency_rule(recency: Column, threshold) -> Column:
    return (recency >= threshold).cast("int")


def classification(df: DataFrame, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts, precision, recall, F1 (zero when undefined) and balanced accuracy."""
    y, p = F.col("churn"), F.col(predicted)
    counts = df.groupBy(*by).agg(
        count_if((y == 1) & (p == 1)).alias("tp"), count_if((y == 0) & (p == 1)).alias("fp"),
        count_if((y == 1) & (p == 0)).alias("fn"), count_if((y == 0) & (p == 0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    return counts.withColumns({
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, tp + fn), zero),
        "f1": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
        "balanced_accuracy": F.when(tn + fp == 0, ratio(tp, tp + fn)).when(tp + fn == 0, ratio(tn, tn + fp)).otherwise(
            (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2
        ),
    })


def confusion_matrix(df: DataFrame, predicted: str) -> DataFrame:
    return df.groupBy("churn", predicted).agg(F.count(F.lit(1)).alias("rows"))


def ranking(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC area (ties count half) and average precision, per group."""
    scores = df.groupBy(*by, score).agg(F.sum("churn").alias("_t"), F.sum(1 - F.col("churn")).alias("_f"))

    def run(scan):
        return scan.add(
            _ct=prefix("sum", "_t"), _cf=prefix("sum", "_f"), _p=total("sum", "_t"), _n=total("sum", "_f")
        ).df

    curve = ordered_scan(scores, list(by), [F.col(score).desc()], run)
    t, f, ct, cf = (F.col(c).cast("double") for c in ("_t", "_f", "_ct", "_cf"))
    return curve.groupBy(*by).agg(
        F.sum(ratio(f, "_n") * ratio(ct - t / 2, "_p")).alias("roc_auc"),
        F.sum(ratio(t, "_p") * ratio(ct, ct + cf)).alias("average_precision"),
    )


def lift_at(df: DataFrame, score: str, fraction: float = 0.20, by: Sequence[str] = (), tie=("customer_id",)) -> DataFrame:
    """Churn rate among the top fraction over the overall rate; null when nobody churned."""
    require_fractions([fraction], "fraction")
    top = F.col("rank") <= top_count(F.col("group_rows"), fraction)
    rates = ranked(df, score, by, tie).groupBy(*by).agg(
        F.avg(F.when(top, F.col("churn"))).alias("_top"), F.avg("churn").alias("_all")
    )
    return rates.select(*by, ratio("_top", "_all").alias("lift"))


def probability_errors(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Brier score and log loss; probabilities are clipped as double precision allows."""
    eps = 2.220446049250313e-16
    given = F.col(score)
    # A missing score is left out of both means; `least` and `greatest` alone would turn it into a bound.
    p = F.when(given.isNotNull(), F.least(F.greatest(given, F.lit(eps)), F.lit(1 - eps)))
    y = F.col("churn")
    return df.groupBy(*by).agg(
        F.avg(F.pow(y - F.col(score), F.lit(2.0))).alias("brier_score"),
        (-F.avg(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("log_loss"),
    )


def evaluate(
    df: DataFrame, predicted: str, score: str, by: Sequence[str] = (), probabilities: bool = False,
    tie: Sequence[str] = ("customer_id",),
) -> DataFrame:
    """All metrics side by side, one row per group. Each part has one row per group, so joins are small."""
    parts = [classification(df, predicted, by), ranking(df, score, by), lift_at(df, score, 0.20, by, tie)]
    if probabilities:
        parts.append(probability_errors(df, score, by))
    table = parts[0]
    for part in parts[1:]:
        table = table.join(part, list(by)) if by else beside(table, part)
    return table


def capacity_table(
    df: DataFrame, score: str, fractions: Sequence[float] = fixed.CAPACITIES, by: Sequence[str] = (),
    tie: Sequence[str] = ("customer_id",),
) -> DataFrame:
    """Contacts, churners reached, precision, recall and lift when only a fraction can be contacted."""
    require_fractions(fractions, "fractions")
    rows = ranked(df, score, by, tie)
    top = {f: F.col("rank") <= top_count(F.col("group_rows"), f) for f in fractions}
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("churn").alias("_churners"),
        *[count_if(c).alias(f"_c{i}") for i, c in enumerate(top.values())],
        *[F.sum(F.when(c, F.col("churn"))).alias(f"_r{i}") for i, c in enumerate(top.values())],
    )
    lines = F.array(*[
        F.struct(F.lit(float(f)).alias("capacity"), F.col(f"_c{i}").alias("customers_contacted"),
                 F.col(f"_r{i}").alias("churners_reached")) for i, f in enumerate(top)
    ])
    table = sums.select(*by, "_n", "_churners", F.explode(lines).alias("_l")).select(*by, "_n", "_churners", "_l.*")
    precision = ratio("churners_reached", "customers_contacted")
    return table.withColumns({
        "precision": precision,
        "recall": ratio("churners_reached", "_churners"),
        "lift": precision / ratio("_churners", "_n"),
    }).drop("_n", "_churners")


def by_threshold(df: DataFrame, score: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Classification metrics for every threshold in one pass over the rows.

    The confusion counts of a threshold are sums over the rows at or above it, so every row
    is counted once by the highest threshold it reaches, and the few counts are cumulated.
    """
    require_positive(thresholds=list(thresholds))
    levels = sorted(thresholds)
    reached = F.array_max(F.filter(F.array(*[F.lit(float(t)) for t in levels]), lambda t: F.col(score) >= t))
    counts = df.groupBy(*by, reached.alias("_reached")).agg(
        F.sum("churn").alias("_t"), F.sum(1 - F.col("churn")).alias("_f")
    )
    wide = counts.groupBy(*by).agg(
        F.sum("_t").alias("_p"), F.sum("_f").alias("_n"),
        *[F.coalesce(F.sum(F.when(F.col("_reached") >= t, F.col("_t"))), F.lit(0)).alias(f"_t{i}")
          for i, t in enumerate(levels)],
        *[F.coalesce(F.sum(F.when(F.col("_reached") >= t, F.col("_f"))), F.lit(0)).alias(f"_f{i}")
          for i, t in enumerate(levels)],
    )
    rows = F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"_t{i}").alias("tp"), F.col(f"_f{i}").alias("fp"))
        for i, t in enumerate(levels)
    ])
    table = wide.select(*by, "_p", "_n", F.explode(rows).alias("_r")).select(*by, "_p", "_n", "_r.*")
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "_p", "_n"))
    zero = F.lit(0.0)
    sensitivity, specificity = ratio(tp, p), ratio(n - fp, n)
    return table.withColumns({
        "predicted_share": ratio(tp + fp, p + n),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, p), zero),
        "f1": F.coalesce(ratio(2 * tp, p + tp + fp), zero),
        "balanced_accuracy": F.when(n == 0, sensitivity).when(p == 0, specificity).otherwise(
            (sensitivity + specificity) / 2
        ),
    }).drop("_p", "_n")


def recency_by_fold(folds: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Metrics of each recency threshold in every validation fold.

    Rank metrics depend on the fold only, so they are computed once per fold.
    """
    rows = folds.filter("role = 'validation'")
    keys = [c for c in ("fold", "validation_date") if c in folds.columns]
    per_fold = by_threshold(rows, "recency", thresholds, keys)
    ranks = ranking(rows, "recency", ["fold"]).join(lift_at(rows, "recency", 0.20, ["fold"]), "fold")
    return per_fold.join(ranks, "fold")


def tune_recency(folds: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Mean metrics of each recency threshold over validation folds, best first."""
    table = recency_by_fold(folds, thresholds).groupBy("threshold").agg(
        F.avg("balanced_accuracy").alias("mean_balanced_accuracy"),
        F.stddev_samp("balanced_accuracy").alias("std_balanced_accuracy"),
        F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"), F.avg("f1").alias("mean_f1"),
        F.avg("roc_auc").alias("mean_roc_auc"), F.avg("average_precision").alias("mean_average_precision"),
        F.avg("lift").alias("mean_lift"),
    )
    return table.orderBy(F.desc("mean_balanced_accuracy"), F.desc("mean_f1"), "threshold")


def tune_probability(scored: DataFrame, thresholds: Sequence[float] = fixed.PROBABILITY_GRID,
                     score: str = "probability", tie: Sequence[str] = ("customer_id",)) -> DataFrame:
    """Metrics of each probability threshold over out-of-fold scores, best first."""
    require_fractions(thresholds, "thresholds", closed_above=False)
    table = beside(beside(by_threshold(scored, score, thresholds), ranking(scored, score)), lift_at(scored, score, tie=tie))
    return table.orderBy(F.desc("balanced_accuracy"), F.desc("f1"), "threshold")


def choose_recency(folds: DataFrame, thresholds: Sequence[int]) -> int:
    """The threshold with the best mean balanced accuracy, then F1, then the smallest."""
    return best(tune_recency(folds, thresholds))["threshold"]


def best(table: DataFrame, *order) -> dict:
    """First row of a small summary."""
    row = (table.orderBy(*order) if order else table).first()
    if row is None:
        raise ValueError("there is nothing to choose from")
    return row.asDict()


def calibration(df: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Mean score and churn rate in equal-count score bins."""
    edges = exact_quantiles(df, score, {f"e{i}": i / bins for i in range(1, bins)})
    edge = F.array(*[F.col(f"e{i}") for i in range(1, bins)])
    # Edges: one row. A score belongs to the bin after the edges strictly below it.
    array = edges.select(edge.alias("edges")).scalar()
    placed = df.withColumn("_edges", array).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col(score))).cast("int")
    )
    return placed.groupBy("bin").agg(
        F.count(F.lit(1)).alias("rows"), F.avg(score).alias("mean_score"), F.avg("churn").alias("churn_rate")
    )


def adjusted_rand(df: DataFrame, first: str, second: str) -> DataFrame:
    """Adjusted Rand index of two labelings; the work after the contingency table is tiny."""

    def pairs(n: str) -> Column:
        return F.col(n).cast("double") * (F.col(n) - 1) / 2

    cells = df.groupBy(first, second).agg(F.count(F.lit(1)).alias("n"))
    inside = cells.agg(F.sum(pairs("n")).alias("_cells"), F.sum("n").alias("n")).withColumn("_all", pairs("n"))
    rows = cells.groupBy(first).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("_rows"))
    columns = cells.groupBy(second).agg(F.sum("n").alias("n")).agg(F.sum(pairs("n")).alias("_columns"))
    table = beside(beside(inside, rows), columns)
    expected = F.col("_rows") * F.col("_columns") / F.nullif(F.col("_all"), F.lit(0.0))
    highest = (F.col("_rows") + F.col("_columns")) / 2
    return table.select(
        F.coalesce(F.try_divide(F.col("_cells") - expected, highest - expected), F.lit(1.0)).alias("adjusted_rand")
    )
