import random
import re
import time

from lapsewise.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]


def brute(doc, items):
    w, hit, ids = words(doc), set(), set()
    for item, text in items:
        v = words(text)
        k = min(len(v), 13)
        windows = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                ids |= {str(item)} if item is not None else set()
    return len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)


def table(spark, items):
    return spark.createDataFrame(items, "item_id bigint, text string")


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aB1é") for _ in range(r.randint(1, 2)))
    items = [(i, " ".join(word() for _ in range(r.choice([3, 12, 13, 14, 20, 27, 40])))) for i in range(25)]
    items += [(30, items[0][1]), (30, "twice the id"), (None, "words of an item without id"), (31, None), (32, "!!")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 60)))]
        for _ in range(r.randint(0, 2)):
            v = r.choice(items)[1] or ""
            v = v.split()
            a = r.randrange(len(v)) if v and r.random() < 0.5 else 0
            parts += ["--" + "... ".join(v[a:]) + "!", " ".join(word() for _ in range(r.randint(0, 200)))]
        docs.append((i, " ".join(parts)))
    return docs, items


def compare(spark, docs, rows, items):
    found = decontam.find(docs(rows), table(spark, items)).withColumn("bad", decontam.contaminated()).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.item_ids), r.bad) for r in found)
    assert got == sorted((str(r[0]), *brute(r[1], items)) for r in rows)
    return found


def test_equals_brute_force(spark, docs):
    rows, items = corpus(4)
    for r in compare(spark, docs, rows, items):
        hit = [w for s in r.hits for w in words(r.text[s.begin : s.end])]
        assert len(hit) == r.n_hit  # spans are offsets of the original text


def test_parts_change_no_result(spark, docs, monkeypatch):
    monkeypatch.setattr(decontam, "PART_BYTES", 300)
    compare(spark, docs, *corpus(5))


def test_words_over_and_over(spark, docs):
    """Equal words in item and document: thousands of places that all fit."""
    begun = time.process_time()
    found, items, _ = decontam.automaton([("1", " ".join(["a"] * 500)), ("2", " ".join(["a", "b"] * 100))])
    ranges, hit = decontam.scan(" " + "a " * 2000, found, items)
    assert decontam.merged(ranges) == [(0, 2000)] and hit == {0}
    ranges, hit = decontam.scan(" " + "a b " * 700 + "c " + "a " * 12, found, items)
    assert decontam.merged(ranges) == [(0, 1400)] and hit == {1}
    assert time.process_time() - begun < 2
    rows = [(1, "a " * 40 + "b " * 3 + "a b " * 30), (2, "b a " * 9)]
    compare(spark, docs, rows, [(1, "a " * 14 + "b"), (2, "a b " * 8), (3, "a " * 13)])


def test_agreement_of_slices():
    r = random.Random(2)
    for _ in range(300):
        a = [r.choice("ab") if r.random() < 0.1 else "a" for _ in range(r.randint(1, 70))]
        b = [r.choice("ab") if r.random() < 0.1 else "a" for _ in range(r.randint(1, 70))]
        i, j = r.randrange(len(a)), r.randrange(len(b))
        most = min(len(a) - i, len(b) - j)
        want = next((k for k in range(most) if a[i + k] != b[j + k]), most)
        assert decontam._agree(a, i, b, j, most) == want


def test_odd_rows(spark, docs, odd_rows, clashing):
    items = [(1, "a b c d e f g"), (2, None), (None, "one")]
    compare(spark, docs, [r[:2] for r in odd_rows], items)
    kept = decontam.clean(clashing, table(spark, items))
    assert kept.columns == clashing.columns and kept.filter("hits = 'own hits'").count() == len(odd_rows) - 3
    assert decontam.clean(clashing, table(spark, [])).count() == len(odd_rows)
    assert decontam.find(docs([]), table(spark, items)).count() == 0
