"""Token alignment against plain loops over documents, tokens and pairs."""

import hashlib
import random
from collections import Counter

import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from lapsewise.llm import alignment, text as T


def spans(ids, table):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(table[i])))
        at += len(table[i])
    return out


def whole_tokenizer():
    """The vocabulary's own library."""
    found = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.A_FILE}")
    found.encode_special_tokens = True
    return found


def brute(rows):
    """(doc_id, measures) by the definition, document by document."""
    both, whole = alignment.load(alignment.FOLDER), whole_tokenizer()
    tokens, linked, n = [], [], Counter()
    for _, text in rows:
        a = whole.encode(" " + (text or ""), add_special_tokens=False).ids
        b = both.b.encode(text or "")
        want = (" " + (text or "")).encode()
        if not text or b"".join(both.a_bytes[i] for i in a) != want or b"".join(both.b_bytes[i] for i in b) != want:
            a, b = [], []
        sa, sb = spans(a, both.a_bytes), spans(b, both.b_bytes)
        links, begin = [], 0
        for i, (s, e) in zip(a, sa):
            while begin < len(sb) and sb[begin][1] <= s:
                begin += 1
            j = begin
            while j < len(sb) and sb[j][0] < e:
                links.append((i, b[j]))
                j += 1
        n.update(set(links))
        tokens.append((a, b, sa, sb))
        linked.append(links)
    best = Counter()
    for (i, _), c in n.items():
        best[i] = max(best[i], c)
    out = []
    for (doc_id, _), (a, b, sa, sb), links in zip(rows, tokens, linked):
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, i, j = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while i < len(a) and sa[i][1] <= cut:
                ga.append(a[i])
                i += 1
            while j < len(b) and sb[j][1] <= cut:
                gb.append(b[j])
                j += 1
            groups.append(f"{','.join(map(str, ga))}|{','.join(map(str, gb))}")
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((
            doc_id, len(a), len(b), len(groups), len(links), sum(n[p] == best[p[0]] for p in links), sum(n[p] for p in links), digest,
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    (20, "a <|endoftext|> b <s> </s> <unk> <0x41>"), (21, "under▁line"), (22, "  two  spaces  "), (23, "\x00 null"), (24, "日本語 \U0001f600 é é ﬁ ①"),
    (25, "\n\n\t tab\r\n"), (26, "one"), (26, "one"), (27, "​﻿ x"), (28, "ÀÀÀ" * 50),
]


@pytest.mark.parametrize("table", [0, 3, 200, 1 << 20])
def test_equals_brute_force(spark, docs, odd_rows, monkeypatch, table):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeinrst-'é9") for _ in range(r.randint(1, 9))) for _ in range(60)]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 60)))) for i in range(60)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(30)] + ODD
    rows += [x[:2] for x in odd_rows if len(x[1] or "") < 10_000]
    monkeypatch.setattr(alignment, "SLICE_BYTES", 500)
    monkeypatch.setattr(alignment, "HELD", 300)
    monkeypatch.setattr(alignment, "HOT_SHARE", 0.02)
    assert got(alignment.align(docs(rows), table=table)) == brute(rows)


def test_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(alignment.align(table)) == brute([(r.doc_id, r.text) for r in table.collect()])


def test_odd_rows(spark, docs, clashing, odd_rows):
    assert got(alignment.align(clashing)) == brute([r[:2] for r in odd_rows])
    assert alignment.align(docs([])).count() == 0
    assert got(alignment.align(docs([(1, None), (2, "")]))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_ids_are_those_of_the_vocabulary_file():
    both, whole = alignment.load(alignment.FOLDER), whole_tokenizer()
    texts = ["x" * 50_000, " " * 300_000, "\n" * 1000 + "a", "1234567 ½ ²", "don't we'LL 'tis ''", "\u00a0\u2003 a\u0301", "\U0001f469\u200d\U0001f680" * 50, "a\r\n\r\n  b"]
    for text in texts:
        assert both.a.encode_ordinary(" " + text) == whole.encode(" " + text, add_special_tokens=False).ids


def test_groups(spark, docs):
    both = alignment.load(alignment.FOLDER)
    text = "Alignment of tokenizers: über-naïve"
    r = alignment.aligned(docs([(1, text), (2, text), (3, None)])).collect()
    assert len(r) == 1 and r[0].copies == 2
    sides = [(b"".join(both.a_bytes[i] for i in g.a), b"".join(both.b_bytes[i] for i in g.b)) for g in r[0].groups]
    assert all(a == b for a, b in sides) and b"".join(a for a, _ in sides).decode() == " " + text


@pytest.mark.parametrize("most", [0, 1, 5, 50, 1000])
def test_frequent_bound(spark, most):
    r = random.Random(most)
    values = [int(2 ** r.uniform(0, 40)) for _ in range(500)] + [3] * 40
    df = spark.createDataFrame([(v,) for v in values], "n bigint")
    bound = T.frequent_bound(df, "n", most)
    assert sum(v >= bound for v in values) <= most
    assert most < 50 or sum(v >= bound for v in values) > 0
    assert T.frequent_bound(df.filter(F.lit(False)), "n", most) >= 1
