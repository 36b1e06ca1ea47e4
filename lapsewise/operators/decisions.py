"""From scores to ranked retention decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.functions import fixed
from lapsewise.functions.checks import require_columns, require_fractions, require_rules
from lapsewise.functions.numeric import at_most, beside, exact_quantiles, lookup, ratio
from lapsewise.operators.metrics import ranked, top_count

DECISION_COLUMNS = (
    "customer_id", "snapshot_date", "segment", "customer_value", "segment_frequency", "churn_probability",
    "above_model_threshold", "probability_threshold", "campaign_priority_band", "campaign_recommended_action",
    "customer_value_cap", "value_at_risk_score", "probability_rank", "value_at_risk_rank",
    "value_protection_priority_band", "value_protection_recommended_action", "model_version",
)
RETIRED_COLUMNS = ("predicted_churn", "risk_band", "recommended_action")


def risk_cutoffs(scores: DataFrame, score: str, quantiles: Mapping[str, float] | None = None) -> dict[str, float]:
    """Score cutoffs of the risk bands, learned from validation scores."""
    quantiles = quantiles or fixed.RISK_QUANTILES
    require_fractions(list(quantiles.values()), "quantiles", closed_above=False)
    names = {f"q{i}": q for i, q in enumerate(quantiles.values())}
    row = exact_quantiles(scores, score, names).first()
    if row is None or row[0] is None:
        raise ValueError("cutoffs need scores to learn from")
    return dict(zip(quantiles, row))


def check_cutoffs(cutoffs: Mapping[str, float]) -> None:
    if set(cutoffs) != set(fixed.RISK_BANDS[1:]):
        raise ValueError(f"cutoffs must name exactly {list(fixed.RISK_BANDS[1:])}")
    values = [cutoffs[b] for b in fixed.RISK_BANDS[1:]]
    if values != sorted(values) or values[0] < 0 or values[-1] > 1:
        raise ValueError("cutoffs must rise between 0 and 1")


def risk_band(score: Column, medium, high, very_high) -> Column:
    """The band of a score; a missing score has none."""
    low, *upper = fixed.RISK_BANDS
    band = F.when(score.isNotNull(), low)
    for name, cutoff in zip(upper, (medium, high, very_high)):
        band = F.when(score >= cutoff, name).otherwise(band)
    return band


def assign_risk_bands(df: DataFrame, score: str, cutoffs: Mapping[str, float]) -> DataFrame:
    check_cutoffs(cutoffs)
    levels = [F.lit(float(cutoffs[b])) for b in fixed.RISK_BANDS[1:]]
    band = risk_band(F.col(score), *levels)
    order = F.array_position(F.array(*[F.lit(b) for b in fixed.RISK_BANDS]), band).cast("int")
    return df.withColumns({"risk_band": band, "risk_band_order": order})


def priority_band(rank: Column, rows: Column) -> Column:
    """Campaign band of a rank: the top 10 %, the next 10 %, the next 30 % and the rest."""
    share = rank / rows
    band = None
    for upper, name in fixed.PRIORITY_SHARES:
        if upper is None:
            return band.otherwise(name)
        band = F.when(share <= upper, name) if band is None else band.when(share <= upper, name)
    return band


def campaign_priorities(
    scored: DataFrame, score: str, by: Sequence[str] = (), actions: Mapping[str, str] | None = None
) -> DataFrame:
    """Rank by score (ties by customer) and attach the campaign band and its action."""
    rows = ranked(scored, score, by)
    return rows.withColumn("campaign_priority_band", priority_band(F.col("rank"), F.col("group_rows"))).withColumn(
        "campaign_recommended_action", lookup(F.col("campaign_priority_band"), actions or fixed.CAMPAIGN_ACTIONS)
    ).withColumnRenamed("rank", "probability_rank").drop("group_rows")


def value_at_risk(
    decisions: DataFrame, probability: str = "churn_probability", value: str = "customer_value",
    cap_quantile: float = 0.99, value_cap: float | None = None, by: Sequence[str] = (), check: bool = True,
    actions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rank by probability and by probability x capped value; the value itself stays uncapped.

    `check` refuses, with one extra job, missing or out-of-range probabilities and missing or negative
    values. Without it, a row that misses either has no score and ranks last.
    """
    require_columns(decisions, [probability, value], "decisions")
    require_fractions([cap_quantile], "cap_quantile")
    if check:
        require_rules(decisions, {
            "probability_out_of_range": F.col(probability).between(0, 1), "value_negative": F.col(value) >= 0,
        }, "decisions")
    if value_cap is not None:
        if value_cap < 0:
            raise ValueError("value_cap must not be negative")
        capped = decisions.withColumn("customer_value_cap", F.lit(float(value_cap)))
    elif by:
        caps = exact_quantiles(decisions, value, {"customer_value_cap": cap_quantile}, by)
        capped = decisions.join(caps, list(by))
    else:
        cap = exact_quantiles(decisions, value, {"cap": cap_quantile}).scalar()
        capped = decisions.withColumn("customer_value_cap", cap)
    scored = capped.withColumn(
        "value_at_risk_score", F.col(probability) * at_most(F.col(value), F.col("customer_value_cap"))
    )
    # The probability rank may already come with the campaign bands.
    if "probability_rank" not in scored.columns:
        scored = ranked(scored, probability, by).withColumnRenamed("rank", "probability_rank").drop("group_rows")
    scored = ranked(scored, "value_at_risk_score", by).withColumnRenamed("rank", "value_at_risk_rank")
    return scored.withColumn(
        "value_protection_priority_band", priority_band(F.col("value_at_risk_rank"), F.col("group_rows"))
    ).withColumn(
        "value_protection_recommended_action",
        lookup(F.col("value_protection_priority_band"), actions or fixed.VALUE_ACTIONS),
    ).drop("group_rows")


def band_profile(scored: DataFrame, band: str, score: str) -> DataFrame:
    """Customers, share, mean score, churn rate and lift per band."""
    rows = scored.groupBy(band).agg(
        F.count(F.lit(1)).alias("customers"), F.avg(score).alias("average_probability"),
        F.avg("churn").alias("observed_churn_rate"), F.sum("churn").alias("_churners"),
    )
    totals = rows.agg(F.sum("customers").alias("_n"), F.sum("_churners").alias("_all"))
    return beside(rows, totals).withColumns({
        "customer_share": ratio("customers", "_n"),
        "observed_lift": F.col("observed_churn_rate") / ratio("_all", "_n"),
    }).drop("_churners", "_n", "_all")


def strategy_comparison(
    decisions: DataFrame, capacity: float = 0.20, threshold: float = fixed.PROBABILITY_THRESHOLD
) -> DataFrame:
    """What each way of choosing the same number of customers would reach.

    Needs `value_at_risk` columns, `churn` and `customer_value`. The threshold-gated choice is
    left out when fewer customers than contacts reach the threshold.
    """
    gated = F.col("churn_probability") >= threshold
    rows = ranked(
        decisions.withColumn("_gate", F.when(gated, F.col("value_at_risk_score"))).withColumn(
            "_gated", gated.cast("int")
        ),
        # Gated customers first, in value order; the others follow and are never chosen.
        "_gate",
    )
    contacts = top_count(F.col("group_rows"), capacity)
    picks = F.array_compact(F.array(
        F.when(F.col("probability_rank") <= contacts, F.lit("Probability ranking")),
        F.when(F.col("value_at_risk_rank") <= contacts, F.lit("Value-at-risk ranking")),
        F.when((F.col("rank") <= contacts) & (F.col("_gated") == 1), F.lit("Threshold-gated value ranking")),
    ))
    lost = F.when(F.col("churn") == 1, F.col("customer_value"))
    totals = decisions.agg(
        F.sum("churn").alias("_churners"), F.avg("churn").alias("_rate"), F.sum(lost).alias("_lost"),
        F.count(F.lit(1)).alias("_n"),
    )
    chosen = rows.withColumn("strategy", F.explode(picks)).groupBy("strategy").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("churn").alias("_reached"),
        F.sum(lost).alias("_value"), F.avg("customer_value").alias("average_customer_value"),
    )
    return beside(chosen, totals).filter(
        F.col("customers") >= top_count(F.col("_n"), capacity)
    ).select(
        "strategy", "customers",
        ratio("_reached", "customers").alias("churn_precision"), ratio("_reached", "_churners").alias("churn_recall"),
        (ratio("_reached", "customers") / F.col("_rate")).alias("lift"),
        ratio("_value", "_lost").alias("churned_value_coverage"), "average_customer_value",
    )


def strategy_overlap(decisions: DataFrame, capacity: float = 0.20) -> DataFrame:
    """Customers chosen by both rankings."""
    n = decisions.agg(F.count(F.lit(1)).alias("n")).scalar()
    contacts = top_count(F.col("_n"), capacity)
    rows = decisions.withColumn("_n", n)
    return rows.agg(
        F.max(contacts).alias("contacts"),
        F.count(F.when(
            (F.col("probability_rank") <= contacts) & (F.col("value_at_risk_rank") <= contacts), 1
        )).alias("in_both"),
    )


def decision_table(
    scores: DataFrame, segments: DataFrame, model_version: str = fixed.MODEL_VERSION,
    threshold: float = fixed.PROBABILITY_THRESHOLD, value_cap: float | None = None, check: bool = True,
    campaign_actions: Mapping[str, str] | None = None, value_actions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Scores of one snapshot joined with segments, ranked both ways, with bands and actions.

    `scores`: customer_id, snapshot_date, churn_probability. `segments`: customer_id, segment,
    frequency, monetary.
    """
    context = segments.select(
        "customer_id", "segment", F.col("frequency").cast("double").alias("segment_frequency"),
        F.col("monetary").alias("customer_value"),
    )
    flagged = scores.select("customer_id", "snapshot_date", "churn_probability").withColumns({
        "probability_threshold": F.lit(float(threshold)),
        "above_model_threshold": (F.col("churn_probability") >= threshold).cast("int"),
        "model_version": F.lit(model_version),
    })
    joined = flagged.join(context, "customer_id", "left")
    ranked_both = value_at_risk(
        campaign_priorities(joined, "churn_probability", actions=campaign_actions), value_cap=value_cap, check=check,
        actions=value_actions,
    )
    return ranked_both.select(*DECISION_COLUMNS)


def refresh_decisions(
    decisions: DataFrame, threshold: float = fixed.PROBABILITY_THRESHOLD, check: bool = True,
    campaign_actions: Mapping[str, str] | None = None, value_actions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Recompute every derived column from the stored probabilities; retired columns go."""
    kept = decisions.drop(*RETIRED_COLUMNS).select(
        "customer_id", "snapshot_date", "segment", "customer_value", "segment_frequency", "churn_probability",
        "model_version",
    ).withColumns({
        "probability_threshold": F.lit(float(threshold)),
        "above_model_threshold": (F.col("churn_probability") >= threshold).cast("int"),
    })
    ranked_both = value_at_risk(
        campaign_priorities(kept, "churn_probability", actions=campaign_actions), check=check, actions=value_actions
    )
    return ranked_both.select(*DECISION_COLUMNS)
