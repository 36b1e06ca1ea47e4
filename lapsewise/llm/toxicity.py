"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Texts are lower-cased, everything but letters and digits becomes one space, and the runs of 3 to 5
bytes are hashed into 2**20 cells. Per cell the labelled documents are counted in which it occurs,
by class. The log-count ratio of a cell is the log of its smoothed share of
the toxic class over that of the other. The cells that tell the classes apart best become
features: presence times ratio, with weights fitted by logistic regression with a squared penalty.

Counting takes a bounded sample of the labelled documents, about `count_rows` chosen by a hash of
doc_id, and the fit about `fit_rows` of those; the sample's ids are what is broadcast to the scan of
the texts, and features x fit_rows bits are what reaches the driver. Nothing but the text enters a
score, and every text is scored whole.

Defined results: null and empty texts get the score of a text without n-grams; rows without label
are scored, not learnt from; without labels of both classes every score is the share of toxic labels
(0.5 without any); rows repeat as in the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapsewise.llm import text as T
from lapsewise.session import materialise

SIZES = (3, 4, 5)
CELLS = 1 << 20
FEATURES = 1024
COUNT_ROWS, FIT_ROWS = 50_000, 12_000
TOXIC = 0.5


@dataclass(frozen=True)
class Model:
    cells: np.ndarray  # of the features
    weights: np.ndarray  # weight x ratio of each
    bias: float


def cells_of(text: str | None) -> np.ndarray:
    """Cells of all n-grams of a text, with repeats."""
    words = T.alnum_words(text)
    if not words:
        return np.empty(0, np.int64)
    data = b" " + b" ".join(words) + b" "
    sums = T.prefix_sums(data)
    found = []
    for size in SIZES:
        begin = np.arange(len(data) - size + 1)
        found.append((T.span_hash(sums, begin, begin + size) >> np.uint64(44)).astype(np.int64))
    return np.concatenate(found)


def _distinct(cells: np.ndarray, scratch: np.ndarray) -> np.ndarray:
    place = np.arange(len(cells), dtype=np.int32)
    scratch[cells] = place
    return cells[scratch[cells] == place]


def count_cells(rows: DataFrame) -> DataFrame:
    """(cell, toxic, other): documents that hold a cell; cell -1 counts the documents themselves."""

    def run(batches):
        counts, total = np.zeros((2, CELLS), np.int64), [0, 0]
        scratch = np.zeros(CELLS, np.int32)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[label][_distinct(cells_of(text.as_py()), scratch)] += 1
                total[label] += 1
        if sum(total):
            seen = np.flatnonzero(counts.any(axis=0))
            for at in range(0, len(seen), 50_000):
                part = seen[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (part, counts[1][part], counts[0][part])], names=["cell", "toxic", "other"])
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (-1, total[1], total[0])], names=["cell", "toxic", "other"])

    kind = "cell bigint, toxic bigint, other bigint"
    return rows.select("text", "label").mapInArrow(run, kind).groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def choose(counts: DataFrame, toxic: int, other: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells whose shares in the two classes differ most surely, and their log-count ratios."""
    p, q = F.col("toxic") / F.lit(toxic), F.col("other") / F.lit(other)
    pooled = (F.col("toxic") + F.col("other")) / F.lit(toxic + other)
    sure = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * F.lit(1 / toxic + 1 / other) + F.lit(1e-12))
    best = counts.filter("cell >= 0").withColumn("_sure", sure).orderBy(F.desc("_sure"), "cell").limit(features)
    rows = best.select("cell", "toxic", "other").collect()
    cells = np.array([r.cell for r in rows], np.int64)
    ratio = np.array([math.log((r.toxic + 1) / (toxic + 2)) - math.log((r.other + 1) / (other + 2)) for r in rows])
    return cells, ratio


def _columns(cells: np.ndarray) -> np.ndarray:
    column = np.full(CELLS, -1, np.int16 if len(cells) < 32_000 else np.int32)
    column[cells] = np.arange(len(cells))
    return column


def sample(rows: DataFrame, cells: np.ndarray, most: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Presence matrix and labels of about `most` rows."""
    share = min(1.0, most / max(total, 1))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        column, features = _columns(sent.value), len(sent.value)
        for batch in batches:
            bits = []
            for text in batch.column(0):
                here = np.zeros(features, bool)
                at = column[cells_of(text.as_py())]
                here[at[at >= 0]] = True
                bits.append(np.packbits(here).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bits, pa.binary()), batch.column(1), batch.column(2)], names=["bits", "label", "k"])

    key = F.xxhash64("doc_id", "text").alias("k")
    found = chosen.select("text", "label", key).mapInArrow(run, "bits binary, label int, k bigint").orderBy("k").limit(most + most // 10).collect()
    bits = np.frombuffer(b"".join(r.bits for r in found), np.uint8).reshape(len(found), -1)
    return np.unpackbits(bits, axis=1)[:, : len(cells)], np.array([r.label for r in found], np.float32)


def fit(present: np.ndarray, labels: np.ndarray, ratio: np.ndarray, penalty: float = 2e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on present x ratio, by accelerated gradient steps."""
    x = present.astype(np.float32) * ratio.astype(np.float32)
    n, step = len(x), 4.0 / max(float((x**2).sum(axis=1).mean()) + 1, 1.0)
    w, b = np.zeros(x.shape[1], np.float32), math.log((labels.sum() + 1) / (n - labels.sum() + 1))
    ahead, ahead_b = w.copy(), b
    share = np.where(labels > 0, 0.5 * n / max(labels.sum(), 1), 0.5 * n / max(n - labels.sum(), 1)).astype(np.float32)
    for k in range(steps):
        error = share * (1 / (1 + np.exp(-np.clip(x @ ahead + ahead_b, -30, 30))) - labels)
        new, new_b = ahead - step * (x.T @ error / n + penalty * ahead), ahead_b - step * float(error.mean())
        pull = k / (k + 3)
        ahead, ahead_b = new + pull * (new - w), new_b + pull * (new_b - b)
        w, b = new, new_b
    return w, b


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", features: int = FEATURES,
    count_rows: int = COUNT_ROWS, fit_rows: int = FIT_ROWS,
) -> Model:
    # The sample's texts are written once, as counting and fitting both read them.
    rows = materialise(docs.select("doc_id", "text").join(T.learnable(labels, label, count_rows), "doc_id"))
    counts = count_cells(rows).persist()
    try:
        total = counts.filter("cell = -1").first()
        toxic, other = (total.toxic, total.other) if total else (0, 0)
        if not toxic or not other:
            share = toxic / (toxic + other) if toxic + other else 0.5
            odds = 30.0 if share == 1 else -30.0 if share == 0 else 0.0
            return Model(np.empty(0, np.int64), np.empty(0), odds)
        cells, ratio = choose(counts, toxic, other, features)
    finally:
        counts.unpersist()
    present, marks = sample(rows, cells, fit_rows, toxic + other)
    w, b = fit(present, marks, ratio)
    return Model(cells, w * ratio, float(b))


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """The documents with the score as a last column, one pass over the texts."""
    docs = T.without(docs, (score,))
    at, names = docs.columns.index("text"), docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        column = _columns(model.cells)
        for batch in batches:
            found = []
            for text in batch.column(at):
                here = column[cells_of(text.as_py())]
                here = np.unique(here[here >= 0])
                odds = model.bias + float(np.sum(model.weights[here]))
                found.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*names, score])

    return docs.mapInArrow(run, T.with_fields(docs, {score: "double"}))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels)
    found = scored(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", F.coalesce(T.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    mark = "_toxicity_score"
    return scored(docs, train(docs, labels), mark).filter(F.col(mark) < TOXIC).drop(mark)
