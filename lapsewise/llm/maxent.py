"""Language-model scores: a hashed maximum-entropy model with class-factored softmax.

The chance of a word after the words before it is P(class) x P(word in class), each a softmax of
a log-linear model. Classes come from the training counts of all words: the SHORTLIST most frequent words
in classes of near equal summed root counts, further known words in BANDS by count, and one last
class of the rest: words seldom seen and words never seen. Features of the class are hashed: the word before, the two
words before, and skip features, the words two and three places back; of a shortlist word its class
with the word before and with the one two places back. Within bands and the rest words go by their counts,
discounted in the rest to give the unseen word its share.

Counting: tasks sum the words of the training documents before they are shuffled; all counts are kept. At most TABLE
words, the most frequent ones, go to the tasks as a table; the other words of the documents meet
their counts by a join, summed per document. Training: in each of ROUNDS rounds every task takes its
training documents of that round (each document is in one) through mini-batches of adaptive gradient steps, from the
common weights; the touched rows are averaged, weighted by touches, in tasks that each hold
a part of the weights. So every training document counts, the driver holds one model
of fixed size, and what is shuffled grows with the tasks. A training word is taken as if its own place were not counted, so that the
rest learns how often new words come. Scoring: one pass in sparse numpy batches.

Defined results: a null text is empty; the end of a text is a token, so an empty text has one;
a null doc_id is neither held out nor learned from; without training documents every score is 0;
rows repeat as in the input; other columns are ignored. Words are counted by 64-bit hashes.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lapsewise.llm import text as T
from lapsewise.session import materialise

TABLE = 200_000
SHORTLIST, CLASSES, BANDS, WIDTH = 1024, 47, 8, 32  # CLASSES: bands and the rest are among them
ROWS, WORD_ROWS = 1 << 15, 1 << 14
ROUNDS, RATE, BATCH = 2, 0.25, 8192
SLICE_BYTES = 1 << 20
HELD = 1 << 21  # distinct words a task holds before it hands them on
SMOOTH = 0.1

END = np.uint64(0xE17D0F7E87A1B2C3)
_NEVER = np.float32(-1e9)
_BLOCK = 512  # rows of a table that travel together
_SPICE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Vocabulary(NamedTuple):
    """What the table words are, with the sums over all training tokens."""

    words: np.ndarray  # sorted hashes of the table
    counts: np.ndarray
    kind: np.ndarray  # class of each
    slot: np.ndarray  # place in the class, -1 in bands
    inside: np.ndarray  # log chance within a band
    class_bias: np.ndarray
    slot_bias: np.ndarray  # class x slot
    bound: int  # words counted so often are in the table
    total: int
    distinct: int
    discount: float  # of the words of the rest
    unseen: float  # mass of the unseen word within the rest
    rest: float  # mass of the rest


class Weights(NamedTuple):
    of_class: np.ndarray
    of_word: np.ndarray
    class_steps: np.ndarray  # summed squared gradients per row
    word_steps: np.ndarray


def blank() -> Weights:
    zeros = lambda *n: np.zeros(n, np.float32)
    return Weights(zeros(ROWS, CLASSES + 1), zeros(WORD_ROWS, WIDTH), zeros(ROWS), zeros(WORD_ROWS))


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts in a row, an end after each, and the texts' first tokens (one more for the end)."""
    words, starts = T.joined_word_hashes(texts)
    return np.insert(words, starts[1:], END), starts + np.arange(len(starts))


def count_tokens(docs: DataFrame) -> DataFrame:
    """word (hash), n: how often it stands in the texts."""

    def summed(parts):
        words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        n = np.zeros(len(words), np.int64)
        np.add.at(n, at, np.concatenate([c for _, c in parts]))
        return words, n

    def out(part):
        for k in range(0, len(part[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[k : k + 100_000].view(np.int64)) for x in part], names=["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in T.slices((T.lowered(t.as_py()) for t in batch.column(0)), SLICE_BYTES):
                held.append(np.unique(tokens_of(part)[0], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield from out(held[0])
                        held, size = [], 0
        if held:
            yield from out(summed(held))

    return docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, table: int = TABLE) -> Vocabulary:
    """From the written counts; the driver gets the table words and a few sums."""
    bound = max(2, T.frequent_bound(counts, "n", table))
    some = counts.agg(
        F.sum("n"), F.count(F.lit(1)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2),
        F.sum(F.when(F.col("n") < bound, F.col("n"))), F.count_if(F.col("n") < bound),
        F.sum(F.when(F.col("n") == bound, F.col("n"))),
    ).first()
    total, distinct, once, twice, rest, rest_words, edge = (int(x or 0) for x in some)
    often = counts.filter(F.col("n") >= bound).toArrow()
    words, n = often.column("word").to_numpy().view(np.uint64), often.column("n").to_numpy()
    order = np.lexsort((words, -n))
    words, n = words[order], n[order]
    kind, slot, inside = np.empty(len(n), np.int16), np.full(len(n), -1, np.int16), np.zeros(len(n), np.float32)
    short, last = min(SHORTLIST, len(n)), CLASSES - 1 - BANDS
    # Classes: equal shares of the summed root counts, at most WIDTH words each.
    share, k, begin, upto = np.cumsum(np.sqrt(n[:short])), 0, 0, 0
    while begin < short and k < last:
        goal = upto + (share[short - 1] - upto) / (last - k)
        end = min(max(int(np.searchsorted(share, goal, "right")), begin + 1), begin + WIDTH, short)
        kind[begin:end], slot[begin:end] = k, np.arange(end - begin)
        upto, begin, k = share[end - 1], end, k + 1
    short = begin
    mass = np.cumsum(n[short:])
    if len(mass):  # bands of near equal mass
        kind[short:] = last + np.minimum((mass - n[short:]) * BANDS // max(int(mass[-1]), 1), BANDS - 1)
    # A training word stands as if its own place were not counted: the words at the bound fall to the rest.
    sums = np.bincount(kind.astype(np.int64), n * (n > bound), CLASSES + 1) if len(n) else np.zeros(CLASSES + 1)
    sums[CLASSES] = rest + edge
    whole = np.bincount(kind.astype(np.int64), n, CLASSES + 1) if len(n) else np.zeros(CLASSES + 1)
    used = (whole > 0) | (np.arange(CLASSES + 1) == CLASSES)
    class_bias = np.where(used, np.log((sums + SMOOTH) / (sums[used] + SMOOTH).sum()), _NEVER).astype(np.float32)
    slot_bias = np.full((CLASSES + 1, WIDTH), _NEVER, np.float32)
    short_words = slot >= 0
    slot_bias[kind[short_words], slot[short_words]] = np.log(n[short_words] / whole[kind[short_words]])
    inside[~short_words] = np.log(n[~short_words] / whole[kind[~short_words]])
    discount = min(0.9, max(0.1, once / max(once + 2 * twice, 1)))
    unseen = max(SMOOTH, discount * rest_words)
    order = np.argsort(words)
    return Vocabulary(
        words[order], n[order], kind[order], slot[order], inside[order], class_bias, slot_bias, bound, total, distinct,
        discount, unseen, rest - discount * rest_words + unseen,
    )


def look_up(tokens: np.ndarray, words: Vocabulary) -> np.ndarray:
    """Place of each token in the table, -1 outside."""
    if not len(words.words):
        return np.full(len(tokens), -1)
    at = np.minimum(np.searchsorted(words.words, tokens), len(words.words) - 1)
    return np.where(words.words[at] == tokens, at, -1)


def features(place: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Rows of the class features, and keys of the word features, of each token; words outside the table are alike."""
    begin = np.repeat(starts[:-1], np.diff(starts))
    at = np.arange(len(place))
    name = T.mix((place + 2).astype(np.uint64))
    back = []
    for k in (1, 2, 3):
        before = np.roll(name, k)
        before[at - k < begin] = 0
        back.append(before)
    one, two, three = back
    keys = (one + _SPICE[0], T.mix(one + _SPICE[1]) + two, two + _SPICE[2], three + _SPICE[3])
    quarter = ROWS // 4  # each kind of feature has rows of its own
    rows = [((T.mix(k) >> np.uint64(32)) % np.uint64(quarter)).astype(np.int64) + i * quarter for i, k in enumerate(keys)]
    return rows, [one + _SPICE[4], two + _SPICE[5]]


def word_rows(keys: list[np.ndarray], kind: np.ndarray) -> list[np.ndarray]:
    half = WORD_ROWS // 2
    of_class = (kind.astype(np.uint64) + np.uint64(1)) * _SPICE[0]
    return [((T.mix(k ^ of_class) >> np.uint64(32)) % np.uint64(half)).astype(np.int64) + i * half for i, k in enumerate(keys)]


def log_chances(table: np.ndarray, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Log softmax of bias and the rows' sum."""
    x = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        x += np.take(table, r, axis=0)
    x += bias
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x) @ np.ones(x.shape[1], np.float32))[:, None]
    return x


def _descend(table: np.ndarray, steps: np.ndarray, touched: np.ndarray, rows: list[np.ndarray], logs: np.ndarray, target: np.ndarray) -> None:
    """One adaptive gradient step of every row that the batch touches."""
    error = np.exp(logs)
    error[np.arange(len(target)), target] -= 1
    for r in rows:
        order = np.argsort(r.astype(np.uint16), kind="stable")  # a radix sort
        held = r[order]
        first = np.flatnonzero(np.concatenate(([True], held[1:] != held[:-1])))
        gradient, at = np.add.reduceat(error[order], first, axis=0), held[first]
        steps[at] += np.einsum("ij,ij->i", gradient, gradient) / gradient.shape[1]
        table[at] -= RATE / np.sqrt(steps[at] + 1e-3)[:, None] * gradient
        touched[at] += np.diff(np.append(first, len(held)))


def _encoded(texts: list[bytes], words: Vocabulary):
    tokens, starts = tokens_of(texts)
    place = look_up(tokens, words)
    rows, keys = features(place, starts)
    return tokens, starts, place, rows, keys


def learn_round(docs: DataFrame, words: Vocabulary, start: Weights, rounds: int, k: int) -> Weights:
    """Weights after round k of the training documents."""
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((words, start))

    def steps(batches):
        words, start = sent.value
        at, seen = Weights(*(x.copy() for x in start)), [np.zeros(n, np.float32) for n in (ROWS, WORD_ROWS)]
        for batch in batches:
            for part in T.slices((T.lowered(t.as_py()) for t in batch.column(0)), SLICE_BYTES):
                _, _, place, rows, keys = _encoded(part, words)
                # The token's own place is not counted.
                known = place >= 0
                known[known] = words.counts[place[known]] > words.bound
                kind = np.where(known, words.kind[np.maximum(place, 0)] if len(words.kind) else 0, CLASSES).astype(np.int64)
                slot = np.where(known, words.slot[np.maximum(place, 0)] if len(words.slot) else -1, -1)
                for i in range(0, len(place), BATCH):
                    part_rows = [r[i : i + BATCH] for r in rows]
                    logs = log_chances(at.of_class, part_rows, words.class_bias)
                    _descend(at.of_class, at.class_steps, seen[0], part_rows, logs, kind[i : i + BATCH])
                    short = i + np.flatnonzero(slot[i : i + BATCH] >= 0)
                    if len(short):
                        inner = word_rows([x[short] for x in keys], kind[short])
                        logs = log_chances(at.of_word, inner, words.slot_bias[kind[short]])
                        _descend(at.of_word, at.word_steps, seen[1], inner, logs, slot[short])
        for which, (table, moved, touched) in enumerate(((at.of_class, at.class_steps, seen[0]), (at.of_word, at.word_steps, seen[1]))):
            for begin in range(0, len(table), _BLOCK):
                rows = begin + np.flatnonzero(touched[begin : begin + _BLOCK])
                if len(rows):
                    payload = [rows.astype(np.int32), touched[rows], moved[rows], table[rows].astype(np.float16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([which * 1_000_000 + begin]), *[pa.array([x.tobytes()], pa.binary()) for x in payload]],
                        names=["block", "rows", "touched", "steps", "weights"],
                    )

    def average(batches):
        sums: dict[int, list] = {}  # by block: at most one model in all
        for batch in batches:
            for block, rows, touched, moved, weights in zip(*(c.to_pylist() for c in batch.columns)):
                rows, touched, moved = np.frombuffer(rows, np.int32), np.frombuffer(touched, np.float32), np.frombuffer(moved, np.float32)
                weights = np.frombuffer(weights, np.float16).reshape(len(rows), -1).astype(np.float64)
                at = rows - block % 1_000_000
                if block not in sums:
                    sums[block] = [np.zeros(_BLOCK), np.zeros(_BLOCK), np.zeros((_BLOCK, weights.shape[1]))]
                for total, x in zip(sums[block], (touched, moved * touched, weights * touched[:, None])):
                    total[at] += x
        for block, (touched, moved, weights) in sums.items():
            at = np.flatnonzero(touched)
            payload = (at.astype(np.int32) + block % 1_000_000, moved[at] / touched[at], weights[at] / touched[at, None])
            yield pa.RecordBatch.from_arrays(
                [pa.array([block]), *[pa.array([x.astype(kind).tobytes()], pa.binary()) for x, kind in zip(payload, (np.int32, np.float32, np.float32))]],
                names=["block", "rows", "steps", "weights"],
            )

    mine = docs.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == k).select("text")
    parts = mine.mapInArrow(steps, "block bigint, rows binary, touched binary, steps binary, weights binary")
    merged = parts.repartition("block").mapInArrow(average, "block bigint, rows binary, steps binary, weights binary")
    out = Weights(*(x.copy() for x in start))
    for r in merged.collect():  # one model of fixed size
        rows = np.frombuffer(r.rows, np.int32)
        table, moved = (out.of_class, out.class_steps) if r.block < 1_000_000 else (out.of_word, out.word_steps)
        table[rows] = np.frombuffer(r.weights, np.float32).reshape(len(rows), -1)
        moved[rows] = np.frombuffer(r.steps, np.float32)
    sent.unpersist()
    return out


def train(docs: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> Weights:
    weights = blank()
    for k in range(rounds):
        weights = learn_round(docs, words, weights, rounds, k)
    return weights


def token_logs(place: np.ndarray, rows: list[np.ndarray], keys: list[np.ndarray], words: Vocabulary, weights: Weights) -> np.ndarray:
    """Natural log of each token's chance; of tokens outside the table, that of the rest."""
    found = np.zeros(len(place))
    known = place >= 0
    kind = np.where(known, words.kind[np.maximum(place, 0)] if len(words.kind) else 0, CLASSES).astype(np.int64)
    for i in range(0, len(place), BATCH):
        of = slice(i, i + BATCH)
        logs = log_chances(weights.of_class, [r[of] for r in rows], words.class_bias)
        found[of] = logs[np.arange(len(logs)), kind[of]]
    if len(words.kind):
        slot = np.where(known, words.slot[np.maximum(place, 0)], -1)
        band = known & (slot < 0)
        found[band] += words.inside[place[band]]
        short = np.flatnonzero(slot >= 0)
        for i in range(0, len(short), BATCH):
            of = short[i : i + BATCH]
            inner = word_rows([x[of] for x in keys], kind[of])
            logs = log_chances(weights.of_word, inner, words.slot_bias[kind[of]])
            found[of] += logs[np.arange(len(of)), slot[of]]
    return found


_REST = pa.list_(pa.struct([("word", pa.int64()), ("times", pa.int64())]))


def scored(docs: DataFrame, words: Vocabulary, weights: Weights, counts: DataFrame) -> DataFrame:
    """The columns of docs but text, with n_tokens, n_known, base_score and score."""
    docs = T.without(docs, ("n_tokens", "n_known", "base_score", "score"))
    sent = docs.sparkSession.sparkContext.broadcast((words, weights))
    kept = [c for c in docs.columns if c != "text"]
    docs = docs.select(*kept, F.col("text").cast("string").alias("text"))

    def run(batches):
        words, weights = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            begin, texts = 0, batch.column(len(kept))
            for part in T.slices((T.lowered(t.as_py()) for t in texts), SLICE_BYTES):
                tokens, starts, place, rows, keys = _encoded(part, words)
                known, n = place >= 0, np.zeros(len(place))
                if len(words.counts):
                    n = np.where(known, words.counts[np.maximum(place, 0)], 0)
                model = token_logs(place, rows, keys, words, weights)
                base = np.where(known, np.log10(n + SMOOTH), 0)
                rest = []
                for i, j in zip(starts[:-1], starts[1:]):
                    new, times = np.unique(tokens[i:j][~known[i:j]], return_counts=True)
                    rest.append([{"word": w, "times": c} for w, c in zip(new.view(np.int64).tolist(), times.tolist())])
                add = lambda x: np.add.reduceat(x, starts[:-1])
                yield pa.RecordBatch.from_arrays([
                    *[c.slice(begin, len(part)) for c in batch.columns[:-1]], pa.array(np.arange(row, row + len(part))),
                    pa.array(np.diff(starts)), pa.array(add(known.astype(np.int64))), pa.array(add(base)),
                    pa.array(add(model) / math.log(10)), pa.array(rest, _REST),
                ], names=[*kept, "_row", "n_tokens", "n_known", "base_score", "score", "_rest"])
                begin += len(part)
                row += len(part)

    fields = {"_row": "bigint", "n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
    fields["_rest"] = "array<struct<word:bigint,times:bigint>>"
    found = materialise(docs.mapInArrow(run, T.with_fields(docs.select(*kept), fields)))
    # Words outside the table meet their counts by a join; how often a word stands in a document is summed already.
    seldom = counts.filter(F.col("n") < words.bound)
    rest = found.filter(F.size("_rest") > 0).select("_row", F.inline("_rest")).join(seldom, "word", "left")
    n = F.coalesce("n", F.lit(0))
    chance = F.when(n > 0, n - F.lit(words.discount)).otherwise(F.lit(words.unseen)) / F.lit(words.rest)
    more = rest.groupBy("_row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("_known"), F.sum(F.col("times") * F.log10(n + SMOOTH)).alias("_base"),
        F.sum(F.col("times") * F.log10(chance)).alias("_model"),
    )
    alone = words.total + SMOOTH * (words.distinct + 1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return found.drop("_rest").join(more, "_row", "left").select(
        *[F.col(f"`{c}`") for c in kept], "n_tokens", (F.col("n_known") + zero("_known")).alias("n_known"),
        (F.col("base_score") + zero("_base") - F.col("n_tokens") * F.lit(math.log10(alone))).alias("base_score"),
        (F.col("score") + zero("_model")).alias("score"),
    )


def tenth(doc_id):
    """The tenth of the ids that the model doesn't learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0


def judge(docs: DataFrame, table: int = TABLE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    learned = docs.filter(~tenth(F.col("doc_id"))).select("doc_id", F.col("text").cast("string").alias("text"))
    counts = materialise(count_tokens(learned))
    words = vocabulary(counts, table)
    found = scored(docs.select("doc_id", "text"), words, train(learned, words, rounds), counts)
    return found.select(
        "doc_id", F.coalesce(tenth(F.col("doc_id")), F.lit(False)).alias("held_out"), "n_tokens", "n_known",
        F.lit(words.total).cast("bigint").alias("train_tokens"), "base_score", "score",
    )
