"""Periodic runs against a search of all starts and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lapsewise.llm import periodic


def brute_runs(words):
    """Maximal stretches by period: for each period the longest rows of places that equal the place a period on."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(24, 3 * q):
                found.setdefault((s, i + q), q)  # smaller periods come first
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in drop)),
    )


def made(r, n):
    """A sequence with repeats inside repeats."""
    out = []
    while len(out) < n:
        unit = [r.randrange(4) for _ in range(r.choice((1, 1, 2, 3, 5, 8, 9, 13, 16, 17, 30, 45)))]
        if r.random() < 0.4:  # a unit that is itself periodic for the most part
            unit = (unit * r.randint(2, 7))[: r.randint(1, 60)] + [r.randrange(4)]
        out += (unit * r.randint(1, 8))[: r.randint(1, 400)]
    return out[:n]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    for _ in range(60):
        words = made(r, r.choice((3, 23, 24, 25, 60, 150, 400)))
        found = periodic.find_runs(np.array(words, np.uint64))
        assert list(zip(*(x.tolist() for x in found))) == brute_runs(words)


@pytest.mark.parametrize("words", [
    [1] * 700, [1, 2] * 300, ([1] * 40 + [2]) * 9, ([1, 2, 1, 2, 1, 3] * 7 + [4]) * 5, list(range(300)) * 3, (([1] * 33 + [2] * 31) * 3 + [7]) * 4,
])
def test_regular_sequences(words):
    found = periodic.find_runs(np.array(words, np.uint64))
    assert list(zip(*(x.tolist() for x in found))) == brute_runs(words)


def test_fibonacci_words():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    found = periodic.find_runs(np.array(b * 2, np.uint64))
    assert list(zip(*(x.tolist() for x in found))) == brute_runs(b * 2)


def test_wavelet_tree():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 100):
        values = r.permutation(n)
        tree = periodic.WaveletTree(values)
        lo = r.integers(0, n + 1, 300)
        hi = np.maximum(lo, r.integers(0, n + 1, 300))
        least = r.integers(0, n + 2, 300)
        want = [min((v for v in values[a:b] if v >= p), default=n) for a, b, p in zip(lo, hi, least)]
        assert tree.successor(lo, hi, least).tolist() == want


def digest_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, docs):
    r = random.Random(5)
    rows = [(i, " ".join(f"w{x}" for x in made(r, r.choice((0, 1, 5, 40, 200))))) for i in range(150)]
    assert digest_rows(periodic.digests(docs(rows))) == sorted((brute_row(*x) for x in rows), key=str)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    assert digest_rows(periodic.digests(table)) == sorted((brute_row(*x) for x in rows), key=str)


def test_odd_rows(spark, docs, odd_rows, clashing):
    short = [r[:2] for r in odd_rows if len(r[1] or "") < 10_000]
    table = docs(odd_rows)
    kept = table.filter(F.coalesce(F.length("text"), F.lit(0)) < 10_000)
    assert digest_rows(periodic.digests(kept)) == sorted((brute_row(*x) for x in short), key=str)
    found = periodic.collapse(clashing)
    assert set(clashing.columns) <= set(found.columns) and found.count() == len(odd_rows)
    assert periodic.digests(docs([])).count() == 0


def test_spans_of_the_operator(spark, docs):
    found = periodic.collapse(docs([(1, "x " + "a b c " * 9 + "y")])).first()
    assert found.collapsed == "x a b c y" and [tuple(r) for r in found.runs] == [(1, 27, 3)] and found.exponent_milli == 9000


def test_very_long_and_regular(spark, docs):
    rows = [(2, "a " * 60_000), (3, "a b " * 30_000)]
    assert [(r.n_runs, r.length, r.period) for r in periodic.collapse(docs(rows)).orderBy("doc_id").collect()] == [(1, 60_000, 1), (1, 60_000, 2)]
