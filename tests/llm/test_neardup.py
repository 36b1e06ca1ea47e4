"""Near-duplicate groups against brute force on whole sets."""

import random
import re

import numpy as np
import pytest

from lapsewise.llm import neardup


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(rows):
    sets, parent = sets_of([t for _, t in rows]), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[i]), least if sets[i] else doc))
    return sorted(out, key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows, bases = [], [[word() for _ in range(r.randint(1, 150))] for _ in range(12)]
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 3, 5])):
            words[r.randrange(len(words))] = word()
        text = r.choice([" ", "\n", "  "]).join(words)
        rows.append((i, text + " " + passage if r.random() < 0.15 else text.upper() if r.random() < 0.1 else text))
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(docs, seed):
    rows = corpus(seed)
    assert result(neardup.near_duplicates(docs(rows))) == brute(rows)


def test_odd_rows(docs, odd_rows, clashing):
    rows = [r[:2] for r in odd_rows]
    assert result(neardup.near_duplicates(docs(rows))) == brute(rows)
    assert result(neardup.near_duplicates(clashing)) == brute(rows)
    kept = neardup.deduplicate(clashing)
    assert kept.columns == clashing.columns
    found = sorted((str(r.doc_id), r.text or "", r.root) for r in kept.collect())
    # Row 6 equals row 5 nearly, row 7 stands there twice.
    assert len(found) == len(rows) - 2 and ("6", odd_rows[5][1], "own root") not in found


def test_empty_table(docs):
    assert neardup.near_duplicates(docs([])).count() == 0
    assert neardup.deduplicate(docs([])).count() == 0


def test_one_group_of_all_rows(docs):
    """Copies and near copies of one text, far more than a bucket's block."""
    base = [f"t{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(3000)]
    rows += [(3000 + i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :])) for i, k in enumerate(i % 80 for i in range(1500))]
    found = neardup.near_duplicates(docs(rows)).groupBy("component_id").count().collect()
    assert [tuple(r) for r in found] == [(0, 4500)]


def test_links_beside_the_centres(docs, monkeypatch):
    """Chains in which most links do not touch a bucket's centre, with blocks of a few rows."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = []
    for family in range(6):
        words = [f"f{family}w{i}" for i in range(60)]
        for i in range(12):
            rows.append((family * 100 + i, " ".join(words)))
            words = words[2:] + [f"f{family}n{i}a", f"f{family}n{i}b"]
    assert result(neardup.near_duplicates(docs(rows))) == brute(rows)


@pytest.mark.parametrize("seed", [4, 5])
def test_slices_maps_and_parts_change_nothing(docs, monkeypatch, seed):
    """Buckets in slices of a few classes, several maps of wanted ids, forests cut short, lost rows in several parts or by a shuffle."""
    rows = corpus(seed)
    plain = sorted(r.doc_id for r in neardup.deduplicate(docs(rows)).collect())
    for name, value in (("SLICE", 2), ("NODES", 3), ("MAP_BITS", 1024), ("LOST_ROWS", 5), ("LOST_PARTS", 1000)):
        monkeypatch.setattr(neardup, name, value)
    assert result(neardup.near_duplicates(docs(rows))) == brute(rows)
    assert sorted(r.doc_id for r in neardup.deduplicate(docs(rows)).collect()) == plain
    monkeypatch.setattr(neardup, "LOST_PARTS", 0)
    assert sorted(r.doc_id for r in neardup.deduplicate(docs(rows)).collect()) == plain


def test_signature_estimates_similarity():
    r = np.random.default_rng(0)
    for common in (10, 300, 3000):
        a = r.integers(0, 2**63, common + common // 3, dtype=np.uint64)
        b = np.concatenate((a[:common], r.integers(0, 2**63, common // 3, dtype=np.uint64)))
        truth = common / (common + 2 * (common // 3))
        shares = []
        for shift in range(30):
            s = neardup.super_minhash([a + np.uint64(shift), b + np.uint64(shift)])
            assert (s != 2**64 - 1).all()
            shares.append((s[0] == s[1]).mean())
        assert abs(np.mean(shares) - truth) < 0.025


def test_signature_is_a_minimum_over_elements():
    """The batch steps give the same as elements one by one, whatever else is in the batch."""
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 40, 700, 5)]
    together = neardup.super_minhash(sets)
    for s, row in zip(sets, together):
        singles = neardup.super_minhash([s[i : i + 1] for i in range(len(s))])
        assert (singles.min(axis=0) == row).all()
        assert sorted((singles[0] >> np.uint64(32)).tolist()) == list(range(neardup.SLOTS))
