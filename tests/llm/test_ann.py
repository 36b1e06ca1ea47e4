import numpy as np
import pytest

from lapsewise.llm import ann

ROWS = "vec_id bigint, embedding array<float>, label int, score string, rank string, list string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "own", "own", "own") for i, v in rows], ROWS)


def brute(rows, k=20):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if q % 20 == 0:
            scores = sorted(((-float((w * v).sum()), i) for i, w in ok if i != q))
            out[q] = scores[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, scale):
    r = np.random.default_rng(2)
    centres = r.normal(size=(30, 24)) * 2
    x = centres[r.integers(0, 30, 3000)] + r.normal(size=(3000, 24))
    if scale:
        x *= r.uniform(0.2, 3, (3000, 1))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    truth, got = brute(rows), found(ann.neighbours(table(spark, rows)))
    hits = [len({i for _, i in truth[q]} & {i for _, i in got[q]}) for q in truth]
    assert all(len(g) == 20 for g in got.values()) and sum(hits) >= 0.9 * 20 * len(truth)
    exact = {(q, i): s for q in truth for s, i in truth[q]}
    assert all(abs(exact.get((q, i), s) - s) < 1e-12 for q in got for s, i in got[q])


def test_few_and_odd_vectors(spark):
    """Fewer candidates than asked for: all of them, in order, ties to the smaller id."""
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
        (8, []), (9, [float("inf"), 1.0]), (20, [0.0, -1.0]), (20, [0.0, -1.0]), (None, [1.0, 1.0]), (11, [1.0, 2.0, 3.0]),
    ]
    got = found(ann.neighbours(table(spark, rows)))
    assert [i for _, i in got[0]] == [1, 2, 3, 20, 20]
    assert [i for _, i in got[20]] == [0, 1, 2, 3]
    assert ann.neighbours(table(spark, [])).count() == 0
    assert ann.neighbours(table(spark, [(0, [1.0])])).count() == 0


def test_hot_vector(spark, monkeypatch):
    """One vector is most of the table and fills many blocks: the smallest ids come first."""
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "PART", 8)
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 4 else [float(c) for c in r.normal(size=4)]) for i in range(1200)]
    truth, got = brute(rows), found(ann.neighbours(table(spark, rows)))
    for q in truth:
        if rows[q][1] == [1.0, 2.0, 3.0, 4.0]:
            assert [i for _, i in got[q]] == [i for _, i in truth[q]]
    hits = sum(len({i for _, i in truth[q]} & {i for _, i in got[q]}) for q in truth)
    assert hits >= 0.9 * 20 * len(truth)


def test_scan_keeps_the_best():
    r = np.random.default_rng(4)
    x, q = r.normal(size=(3000, 64)), r.normal(size=(40, 64))
    rotation, _ = np.linalg.qr(r.normal(size=(64, 64)))
    i, j = ann.scan(q, x, rotation, 20)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    share = np.mean([len(set(best[n]) & set(j[i == n])) / 20 for n in range(40)])
    assert share > 0.97 and len(i) < 40 * 30
    floor = np.sort(q @ x.T, axis=1)[:, -3]  # two candidates beat it
    i, j = ann.scan(q, x, rotation, 20, floor=floor)
    assert share > 0.97 and 80 <= len(i) <= 40 * 4
