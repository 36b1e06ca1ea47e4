"""Mixing sources to target weights by capped water-filling.

Every source gets words in proportion to its weight until it would repeat more than `cap` times;
a source at its cap keeps cap x size and the rest is shared again among the others, until no
target exceeds its cap. Documents are then taken in whole repetitions, and a seeded part of the
documents once more for the fraction that is left.

Defined results: a null text has size 0 and is taken 0 times; documents with a null source form a
source of their own; an empty table gives an empty table; rows that repeat a doc_id are taken or
left together; a source without words has target 0. Input columns called like an output column
are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lapsewise.llm.text import SPACED, without
from lapsewise.operators.scans import ordered_scan, position
from lapsewise.session import materialise

COPIES = "_mix_copies"
OUTPUT = ("size", "source_size", "target", "taken")
# Hex digits of the seeded key that name a bucket; a source's cut-off is searched bucket by bucket.
BUCKET_DIGITS = 3


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED)), F.lit(0)).cast("bigint")


def seeded_key(doc_id: Column, seed: str) -> Column:
    """A fixed random order of the documents: 32 hex digits."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def weigh(sources: DataFrame, weights: Sequence[int]) -> DataFrame:
    """Give the sources the repeating weights in code-point order, null last."""
    ranked = ordered_scan(sources, (), [F.col("source").asc_nulls_last()], lambda s: s.add(_rank=position()).df)
    cycle = F.array(*[F.lit(w) for w in weights])
    return ranked.withColumn("weight", F.get(cycle, ((F.col("_rank") - 1) % len(weights)).cast("int"))).drop("_rank")


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Add `target` to a written table of (source, source_size, weight).

    A round is one aggregate over the sources: the level is what is left per unit of weight after
    the capped sources took theirs. It only rises, so the rounds end.
    """
    full = F.lit(cap) * F.col("source_size")
    level = 0.0
    while True:
        capped = full < F.lit(level) * F.col("weight")
        total, stuck, weight = sources.agg(
            F.sum("source_size"), F.sum(F.when(capped, F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        if not weight:
            break
        higher = (share * total - cap * (stuck or 0)) / weight
        if higher <= level:
            break
        level = higher
    return sources.withColumn("target", F.least(full, F.lit(level) * F.col("weight")))


def source_plan(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix-1"
) -> DataFrame:
    """Per source: source_size, weight, target, repeats (whole) and cutoff (keys up to it are taken once more)."""
    narrow = docs.select(
        "source", words(F.col("text")).alias("size"), seeded_key(F.col("doc_id"), seed).alias("key")
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = materialise(narrow.groupBy("source", "bucket").agg(F.sum("size").alias("size")))
    sources = materialise(weigh(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    filled = water_fill(sources, share, cap)
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    filled = filled.withColumn("repeats", repeats.cast("bigint")).withColumn(
        "quota", F.col("target") - F.col("repeats") * F.col("source_size")
    )
    # A source has at most 16 ** BUCKET_DIGITS buckets, so this window is small for the largest source too.
    upto = F.sum("size").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    crossing = (
        buckets.withColumn("upto", upto).alias("b").join(filled.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        .filter(F.col("upto") > F.col("quota"))
        .groupBy(F.col("b.source").alias("source"), "quota")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before")), "bucket").alias("at"))
        .select("source", "quota", "at.*")
    )
    inside = narrow.alias("n").join(
        crossing.alias("c"), F.col("n.source").eqNullSafe(F.col("c.source")) & (F.col("n.bucket") == F.col("c.bucket"))
    ).groupBy(F.col("c.source").alias("source"), F.col("c.bucket").alias("bucket"), "quota", "before", "key").agg(
        F.sum("size").alias("size")
    )
    running = F.sum("size").over(W.partitionBy("source", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, 0))
    cut = (
        inside.withColumn("middle", F.col("before") + running - F.col("size") / 2.0)
        .groupBy("source", "bucket")
        .agg(F.max(F.when(F.col("middle") <= F.col("quota"), F.col("key"))).alias("last"))
        # Without a key of the crossing bucket the cut lies before its first key, which is longer than its name.
        .select("source", F.coalesce("last", "bucket").alias("cutoff"))
    )
    return (
        filled.alias("s").join(cut.alias("k"), F.col("s.source").eqNullSafe(F.col("k.source")), "left")
        .select("s.source", "source_size", "weight", "target", "repeats", F.coalesce("cutoff", F.lit("g")).alias("cutoff"))
    )


def mix(docs: DataFrame, seed: str = "mix-1", **shares) -> DataFrame:
    """The documents with size, source_size, target and taken (words the mix takes, repeats counted)."""
    plan = materialise(source_plan(docs, seed=seed, **shares))
    kept = without(docs, (*OUTPUT, COPIES))
    again = (seeded_key(kept["doc_id"], seed) <= plan["cutoff"]).cast("bigint")
    size = words(kept["text"])
    copies = plan["repeats"] + again
    return kept.join(plan, kept["source"].eqNullSafe(plan["source"])).select(
        *[kept[f"`{c}`"] for c in kept.columns], size.alias("size"), plan["source_size"], plan["target"],
        (size * copies).alias("taken"), copies.alias(COPIES),
    )


def repeated(docs: DataFrame, **shares) -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it, numbered by `copy` from 1.

    Documents without words are taken 0 times.
    """
    mixed = mix(without(docs, ("copy",)), **shares).filter(F.col("taken") > 0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(COPIES).cast("int")))).drop(COPIES)
