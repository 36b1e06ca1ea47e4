"""Language-model scores against a plain scorer, token by token, and base scores against a word counter."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lapsewise.llm import maxent, text as T

M64 = (1 << 64) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def is_tenth(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 10 == 0


def mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def hashed(words):
    return [int(T.joined_word_hashes([w.encode()])[0][0]) for w in words] + [int(maxent.END)]


def plain_base(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score by the definition."""
    seen = Counter()
    for doc_id, text in rows:
        if doc_id is not None and not is_tenth(doc_id):
            seen.update([*words_of(text), None])
    total = sum(seen.values())
    out = []
    for doc_id, text in rows:
        tokens = [*words_of(text), None]
        base = sum(math.log10((seen[t] + 0.1) / (total + 0.1 * (len(seen) + 1))) for t in tokens)
        out.append((doc_id, doc_id is not None and is_tenth(doc_id), len(tokens), sum(seen[t] > 0 for t in tokens), total, base))
    return sorted(out, key=str)


def softmax(values):
    top = max(values)
    e = [math.exp(v - top) for v in values]
    return [x / sum(e) for x in e]


def outcomes(history, v, w, counts):
    """The chance of every known word, by its hash, and of the unseen one (None), after up to three words."""
    place = {int(h): i for i, h in enumerate(v.words)}
    one, two, three = [mix(place.get(history[-k], -1) + 2) if len(history) >= k else 0 for k in (1, 2, 3)]
    spice = [int(x) for x in maxent._SPICE]
    keys = [one + spice[0], mix((one + spice[1]) & M64) + two, two + spice[2], three + spice[3]]
    quarter, half = maxent.ROWS // 4, maxent.WORD_ROWS // 2
    rows = [(mix(k & M64) >> 32) % quarter + i * quarter for i, k in enumerate(keys)]
    classes = softmax([float(v.class_bias[c]) + sum(float(w.of_class[r, c]) for r in rows) for c in range(maxent.CLASSES + 1)])
    chance, inner = {}, {}
    for h, i in place.items():
        c, slot = int(v.kind[i]), int(v.slot[i])
        if slot < 0:
            chance[h] = classes[c] * math.exp(v.inside[i])
            continue
        if c not in inner:
            of = [(mix(((k + s) & M64) ^ ((c + 1) * spice[0] & M64)) >> 32) % half + j * half for j, (k, s) in enumerate(((one, spice[4]), (two, spice[5])))]
            inner[c] = softmax([float(v.slot_bias[c, x]) + sum(float(w.of_word[r, x]) for r in of) for x in range(maxent.WIDTH)])
        chance[h] = classes[c] * inner[c][slot]
    for h, n in counts.items():
        if n < v.bound:
            chance[h] = classes[-1] * (n - v.discount) / v.rest
    chance[None] = classes[-1] * v.unseen / v.rest
    return chance


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(4)
    sides = [[f"{side}{i}" for i in range(150)] for side in "ab"]
    rows = []
    for i in range(160):
        vocabulary = sides[i % 2]
        text = " ".join(vocabulary[min(149, int(r.expovariate(0.05)))] for _ in range(r.randint(0, 90)))
        rows.append((i, text.title() if i % 7 == 0 else text + (f" new{i} new{i}" if i % 5 == 0 else "")))
    return rows


@pytest.mark.parametrize("table", [1 << 20, 40, 0])
def test_equals_plain_scorer(spark, docs, corpus, monkeypatch, table):
    monkeypatch.setattr(maxent, "SLICE_BYTES", 700)
    monkeypatch.setattr(maxent, "HELD", 50)
    monkeypatch.setattr(maxent, "SHORTLIST", 60)
    frame = docs(corpus)
    learned = frame.filter(~maxent.tenth(frame["doc_id"]))
    counts = maxent.materialise(maxent.count_tokens(learned))
    words = maxent.vocabulary(counts, table)
    weights = maxent.train(learned, words)
    known = {r.word & M64: r.n for r in counts.collect()}
    assert known == Counter(h for i, t in corpus if not is_tenth(i) for h in hashed(words_of(t)))
    found = {r.doc_id: r for r in maxent.scored(frame.select("doc_id", "text"), words, weights, counts).collect()}
    for doc_id, text in corpus[::23]:
        tokens, total = hashed(words_of(text)), 0.0
        for i, token in enumerate(tokens):
            chance = outcomes(tokens[max(0, i - 3) : i], words, weights, known)
            assert sum(chance.values()) == pytest.approx(1, abs=1e-4)
            total += math.log10(chance[token if token in known else None])
        assert found[doc_id].score == pytest.approx(total, rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("table", [1 << 20, 30])
def test_base_score(spark, docs, corpus, odd_rows, table):
    rows = corpus + [r[:2] for r in odd_rows]
    got = sorted((tuple(r)[:6] for r in maxent.judge(docs(rows), table=table).collect()), key=str)
    for a, b in zip(got, plain_base(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)


def test_better_than_counts_where_not_learned(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in maxent.judge(table).collect() if r.held_out]
    assert len(rows) > 50 and sum(r.score > r.base_score for r in rows) > 0.9 * len(rows)
    # 3.33 against 4.10 decimal digits a token when written
    assert sum(r.score for r in rows) > 0.85 * sum(r.base_score for r in rows)


def test_reruns_agree(spark, docs, corpus):
    one, two = ({r.doc_id: r.score for r in maxent.judge(docs(corpus)).collect()} for _ in range(2))
    assert all(one[k] == pytest.approx(two[k], rel=1e-6) for k in one)


def test_odd_tables(spark, docs, clashing, odd_rows):
    assert maxent.judge(docs([])).count() == 0
    found = maxent.judge(clashing)
    assert found.count() == len(odd_rows) and all(np.isfinite(r.score) and r.score <= 0 for r in found.collect())
    held = next(i for i in range(100) if is_tenth(i))
    r = maxent.judge(docs([(held, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    r = maxent.judge(docs([(None, "a b"), (1, None)])).filter("doc_id IS NULL").first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (False, 3, 1, 1)
