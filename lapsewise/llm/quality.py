"""Text quality by a sparse rule ensemble.

Every text is reduced to a few statistics (shares of symbols, capitals, digits and repeats, word
and line lengths). A random forest of shallow trees is grown on the labelled rows; every path from
a root to a node is a rule, a conjunction of comparisons on statistics. A logistic regression with
an absolute-value penalty (lasso) on the rules keeps few of them, and the kept ones are compiled
into one Spark column expression, so scoring needs no model code.

Forest and regression are Spark ML fits over a bounded sample of about `most` labelled documents that
are not held out, chosen by a hash of doc_id; every document is scored.

Defined results: null and empty texts have all statistics 0 and are scored like any other;
without labels of both classes every score is the share of good labels (0.5 without any); rows
repeat as in the input; columns other than doc_id and text do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F

from lapsewise.llm import text as T
from lapsewise.session import materialise

GOOD = 0.3
TREES, DEPTH, PENALTY = 24, 3, 0.002
FIT_ROWS = 50_000

STATISTICS = (
    "log_words", "mean_word", "longest_word", "upper", "digits", "symbols", "marks", "pipes", "non_ascii", "spaces",
    "caps_words", "symbol_ends", "distinct_words", "distinct_fives", "top_word", "stuck_words", "lines", "mean_line",
    "distinct_lines", "line_ends", "short_lines", "entropy",
)

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_HIGH = np.arange(256) > 127
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _HIGH | _SPACE)
_PLAIN_MARK = np.isin(np.arange(256), [ord(c) for c in ".,;:?'\"-()"])


def statistics(text: str | None) -> list[float]:
    data = T.utf8(text)
    begin, end = T.word_spans(data)
    words = len(begin)
    if not words:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(data, np.uint8)
    histogram = np.bincount(codes, minlength=256)
    size = len(codes)
    share = lambda kind: float(histogram[kind].sum()) / size
    lengths = end - begin
    upto = lambda kind: np.concatenate(([0], np.cumsum(kind[codes])))
    upper, lower = upto(_UPPER), upto(_LOWER)
    capitals = (upper[end] - upper[begin] >= 2) & (lower[end] == lower[begin])
    last = codes[end - 1]
    hashes = T.word_hashes(data)
    _, counts = np.unique(hashes, return_counts=True)
    fives = T.sequence_hashes(hashes, 5)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = histogram[histogram > 0] / size
    return [
        float(np.log1p(words)), float(lengths.mean()), float(lengths.max()), share(_UPPER), share(_DIGIT),
        share(_SYMBOL & ~_PLAIN_MARK), share(_PLAIN_MARK), float(histogram[124]) / size, share(_HIGH), share(_SPACE),
        float(capitals.mean()), float((_SYMBOL & ~_PLAIN_MARK)[last].mean()), len(counts) / words,
        len(np.unique(fives)) / len(fives), float(counts.max()) / words,
        float((hashes[1:] == hashes[:-1]).mean()) if words > 1 else 0.0, float(np.log1p(len(lines))),
        float(np.log1p(size / len(lines))), len(set(lines)) / len(lines),
        sum(x.rstrip().endswith((b".", b"!", b"?", b":")) for x in lines) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines), float(-(p * np.log2(p)).sum()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every document."""

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in rows.T]], names=["doc_id", *STATISTICS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {fields}")


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, threshold) hold."""

    conditions: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        parts = [F.col(s) > F.lit(t) if above else F.col(s) <= F.lit(t) for s, above, t in self.conditions]
        whole = parts[0]
        for part in parts[1:]:
            whole &= part
        return whole


@dataclass(frozen=True)
class Ensemble:
    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def score(self) -> Column:
        odds = F.lit(self.bias)
        for rule, weight in self.rules:
            odds += F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


_BRANCH = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def rules_of(tree_text: str, names: Sequence[str] = STATISTICS) -> list[Rule]:
    """Every path to a node below the root, from a tree's printed form."""
    path, found = [], []
    for line in tree_text.splitlines():
        m = _BRANCH.match(line)
        if m:
            depth = len(m[1])
            path = [x for x in path if x[0] < depth] + [(depth, (names[int(m[2])], m[3] == ">", float(m[4])))]
            found.append(Rule(_tight([c for _, c in path])))
    return found


def _tight(conditions: list[tuple[str, bool, float]]) -> tuple[tuple[str, bool, float], ...]:
    """Keep the narrowest bound per statistic and side."""
    kept: dict[tuple[str, bool], float] = {}
    for s, above, t in conditions:
        old = kept.get((s, above), t)
        kept[s, above] = max(old, t) if above else min(old, t)
    return tuple(sorted((s, above, t) for (s, above), t in kept.items()))


def train(stats: DataFrame, labels: DataFrame, label: str = "quality", most: int = FIT_ROWS) -> Ensemble:
    known = T.learnable(labels, label, most)
    rows = materialise(stats.join(known, "doc_id").select(F.col("label").cast("double").alias("label"), *STATISTICS))
    n, good = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or good in (0, n):
        return Ensemble((), 0.0 if not n else 30.0 if good else -30.0)
    assembled = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("features", "label")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", subsamplingRate=0.5, seed=11
    ).fit(assembled)
    rules = list(dict.fromkeys(r for tree in forest.trees for r in rules_of(tree.toDebugString)))
    if not rules:
        return Ensemble((), float(np.log(good / (n - good))))
    held = rows.select(
        "label", F.array(*[F.when(r.column(), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules]).alias("held")
    )
    # Few different answers occur: the fit runs over the distinct ones, weighted by their rows.
    answers = materialise(held.groupBy("label", "held").agg(F.count(F.lit(1)).cast("double").alias("rows")))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False, weightCol="rows")
    fitted = lasso.fit(answers.select("label", "rows", array_to_vector("held").alias("features")))
    weights = tuple((r, float(w)) for r, w in zip(rules, fitted.coefficients) if w)
    return Ensemble(weights, float(fitted.intercept))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    stats = materialise(with_statistics(docs))
    scored = stats.withColumn("score", train(stats, labels).score())
    return scored.select(
        "doc_id", F.coalesce(T.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= GOOD).cast("int").alias("predicted"),
    )
