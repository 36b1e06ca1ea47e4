"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q and at least max(24, 3q) words that cannot be
longer with that period. The steps for one text:

1. Names: equal stretches of 2**k words get equal numbers, k = 0, 1, ... until all differ, by
   sorting pairs of names. The last names order the suffixes; two places are compared by names, longest first.
2. A wavelet tree over the suffix array answers "first place at or after p where this block stands".
3. Every run holds an aligned block of 2**k words a period before a copy of it: of 8 words for
   periods up to 15, else of m words for periods from m to 2m - 1. So every aligned block asks for its copies
   in the window behind it. Two copies at most m/2 apart belong to an arithmetic progression with
   the block's own period r; a run of a longer period meets another such progression, and their
   first or last words are one period apart.
4. Every candidate period is extended to both sides, which gives the whole run or shows it too short; equal stretches keep the least period.

A text has at most as many queries as words, and no pair of places is listed without a period.
Runs of at least 24 words and 3 periods repeat 16 words one period later: texts
in which no 16 words repeat (by hash, so none is missed) have none and skip the steps. Texts are
taken whole; a task holds some 4 MB of texts, or one text, and some 4 log2(n) bytes a word of it.

Words are compared by 64-bit hashes of their bytes. Defined results: a null or empty text has no
words; rows repeat as in the input; a null doc_id has a text left as it is; columns called like an
output column are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lapsewise.llm import text as T

LEAST, REPEATS = 24, 3
# Words that every run repeats one period later; words of the smallest blocks (2 ** FIRST).
ECHO, FIRST = 16, 3
SLICE_BYTES = 4 << 20


class Runs(NamedTuple):
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


NO_RUNS = Runs(*(np.empty(0, np.int64) for _ in range(3)))


class Names:
    """Numbers for all stretches of 2**k words; equal numbers say equal stretches."""

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        self.levels = [np.unique(words, return_inverse=True)[1].astype(np.int64)]
        while self.levels[-1].max(initial=0) < n - 1:
            step, last = 1 << (len(self.levels) - 1), self.levels[-1]
            after = np.zeros(n, np.int64)  # 0: the text ends before; such stretches equal no others
            after[: max(0, n - step)] = last[step:] + 1
            self.levels.append(np.unique(last * (n + 1) + after, return_inverse=True)[1].astype(np.int64))
        self.levels = [x.astype(np.int32) for x in self.levels]
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.levels[-1]] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on; i and j differ."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            a, b = i + total, j + total
            inside = np.maximum(a, b) + (1 << k) <= self.n
            names = self.levels[k]
            total += (inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 0)])).astype(np.int64) << k
        return total

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        total = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 2, -1, -1):
            a, b = i - total - (1 << k), j - total - (1 << k)
            inside = np.minimum(a, b) >= 0
            names = self.levels[k]
            total += (inside & (names[np.where(inside, a, 0)] == names[np.where(inside, b, 0)])).astype(np.int64) << k
        return total


class WaveletTree:
    """Range successor over an array that holds every number below its length once."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), []
        for bit in range(max(1, (self.n - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.levels.append((bit, np.concatenate(([0], np.cumsum(~one))).astype(np.int32)))
            values = np.concatenate((values[~one], values[one]))

    def below(self, lo: np.ndarray, hi: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in [lo, hi) are smaller than the bound (below 2 ** bits)."""
        count = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b, one = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64), (bound >> bit & 1).astype(bool)
            count += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return count

    def ranked(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The value in [lo, hi) with so many smaller ones there."""
        value = np.zeros(len(lo), np.int64)
        for bit, zeros in self.levels:
            a, b = zeros[lo].astype(np.int64), zeros[hi].astype(np.int64)
            one = rank >= b - a
            rank = np.where(one, rank - (b - a), rank)
            value |= one.astype(np.int64) << bit
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return value

    def successor(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value in [lo, hi) of at least `least`, n if there is none."""
        found = np.full(len(lo), self.n, np.int64)
        ask = np.flatnonzero(least < self.n)
        rank = self.below(lo[ask], hi[ask], least[ask])
        some = rank < hi[ask] - lo[ask]
        ask = ask[some]
        found[ask] = self.ranked(lo[ask], hi[ask], rank[some])
        return found


def _candidates(names: Names, tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of 2**k words and the periods their copies suggest."""
    m, level = 1 << k, names.levels[k]
    block = np.arange(0, names.n - m + 1, m)
    ends = np.cumsum(np.bincount(level))
    hi = ends[level[block]]
    lo = np.concatenate(([0], ends))[level[block]]
    often = hi - lo > 1
    block, lo, hi = block[often], lo[often], hi[often]
    # The smallest blocks stand for all short periods, so they take every copy there is in their window.
    smallest = k == FIRST
    place, last = block + (1 if smallest else m), np.minimum(block + 2 * m, names.n) - 1
    found = []
    while len(block):
        copy = tree.successor(lo, hi, place)
        going = copy <= last
        block, lo, hi, last, copy = (x[going] for x in (block, lo, hi, last, copy))
        if smallest:
            found.append((block, copy - block))
            place = copy + 1
            continue
        second = tree.successor(lo, hi, copy + 1)
        close = (second <= last) & (second - copy <= m // 2)
        found.append((block[~close], (copy - block)[~close]))
        place = copy + 1
        if close.any():
            b, c, r = block[close], copy[close], (second - copy)[close]
            first, past = b - names.behind(b, b + r), b + r + names.ahead(b, b + r)
            first_copy, past_copy = c - names.behind(c, c + r), c + r + names.ahead(c, c + r)
            other = first_copy != first
            for d in (first_copy - first, past_copy - past):
                found.append((b[other], d[other]))
            place[close] = past_copy - m + 1
    blocks, periods = (np.concatenate(x) if found else np.empty(0, np.int64) for x in (list(zip(*found)) or ([], [])))
    right = (periods > 0) & (blocks + periods < names.n)
    return blocks[right], periods[right]


def find_runs(words: np.ndarray) -> Runs:
    """All runs of a sequence of numbers, by start, then period."""
    if len(words) < LEAST:
        return NO_RUNS
    names, found = Names(words), []
    tree = WaveletTree(names.suffixes)
    for k in range(FIRST, len(names.levels) - 1):
        if k > FIRST and REPEATS << k > names.n:
            break
        block, period = _candidates(names, tree, k)
        start = block - names.behind(block, block + period)
        end = block + period + names.ahead(block, block + period)
        long = end - start >= np.maximum(LEAST, REPEATS * period)
        found.append(np.stack((start[long], end[long], period[long])))
    if not found:
        return NO_RUNS
    start, end, period = np.unique(np.concatenate(found, axis=1), axis=1)
    # A stretch found with several periods comes with the least one first.
    first = np.concatenate(([True], (start[1:] != start[:-1]) | (end[1:] != end[:-1]))) if len(start) else np.empty(0, bool)
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return Runs(start[order], (end - start)[order], period[order])


def kept_words(runs: Runs, n: int) -> np.ndarray:
    """False for words that any run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.start + runs.length, -1)
    return np.cumsum(change[:-1]) == 0


def strongest(runs: Runs) -> tuple[int, int, int] | None:
    """The run with the greatest length by period, compared exactly; of equals the first, then the shortest period."""
    best = None
    for s, length, q in zip(*(x.tolist() for x in runs)):
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return best


def may_repeat(words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For texts in one row of words: False where no stretch of ECHO words stands twice in a text."""
    texts = len(starts) - 1
    grams = T.window_hashes(words, ECHO)
    owner = np.repeat(np.arange(texts), np.diff(starts))[: len(grams)]
    inside = np.arange(len(grams)) + ECHO <= starts[owner + 1]
    grams, owner = grams[inside], owner[inside]
    keys = T.mix(grams + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    again = owner[order[1:]][keys[order[1:]] == keys[order[:-1]]]
    found = np.zeros(texts, bool)
    found[again] = True
    return found


def periodic_tail(doc_id, n: int) -> tuple[int, int] | None:
    """(first word, period) that the query's contract writes into the texts of some ids."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


FIELDS = {
    "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), "collapsed": pa.string(),
}
_KINDS = dict.fromkeys(FIELDS, "bigint") | {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def _rows(ids: list, texts: list[bytes], rewrite: Callable | None) -> list[tuple]:
    hashes, starts = T.joined_word_hashes(texts)
    places = {}
    for k in range(len(texts)) if rewrite else ():
        n = int(starts[k + 1] - starts[k])
        if tail := rewrite(ids[k], n):
            a, p = tail
            at = np.arange(n)
            places[k] = np.where(at >= a, a + (at - a) % p, at)
            hashes[starts[k] : starts[k + 1]] = hashes[starts[k] : starts[k + 1]][places[k]]
    repeats, rows = may_repeat(hashes, starts), []
    for k, text in enumerate(texts):
        runs = find_runs(hashes[starts[k] : starts[k + 1]]) if repeats[k] else NO_RUNS
        words = text.split()
        if k in places:
            words = [words[i] for i in places[k].tolist()]
        if len(runs.start):
            words = [w for w, keep in zip(words, kept_words(runs, len(words)).tolist()) if keep]
        s, length, q = strongest(runs) or (None, None, None)
        rows.append((
            len(runs.start), s, length, q, 1000 * length // q if q else None,
            [{"start": a, "length": b, "period": c} for a, b, c in zip(*(x.tolist() for x in runs))], b" ".join(words).decode(),
        ))
    return rows


def collapse(docs: DataFrame, rewrite: Callable | None = None) -> DataFrame:
    """The documents with n_runs, the strongest run, all runs, and the text with each run cut to its first period.

    `rewrite` may give, for a doc_id and its number of words, where a periodic tail starts and its
    period; the text is then taken with that tail.
    """
    docs = T.without(docs, FIELDS)
    at, named, fields = docs.columns.index("text"), docs.columns.index("doc_id"), docs.columns

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(named).to_pylist(), batch.column(at)
            begin = 0
            for part in T.slices((T.utf8(t.as_py()) for t in texts), SLICE_BYTES):
                rows = _rows(ids[begin : begin + len(part)], part, rewrite)
                arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(FIELDS.values())]
                kept = [c.slice(begin, len(part)) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*fields, *FIELDS])
                begin += len(part)

    return docs.mapInArrow(run, T.with_fields(docs, _KINDS))


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns, over texts of which a tenth get a periodic tail."""
    found = collapse(docs.select("doc_id", F.col("text").cast("string").alias("text")), periodic_tail)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
