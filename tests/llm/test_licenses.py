import re

import pytest

from lapsewise.llm import licenses

TEXTS = [
    (1, "Licensed under the Apache License, Version 2.0."), (2, None), (3, ""), (4, "mit license MIT-License cc by CC BY cc by"),
    (5, "GNU General Public License v3 or later"), (6, "nothing to see, commit licenses mitlicense"), (7, "cc-by-sa 4.0 " * 40),
    (8, "é mit\nLICENSE x apache\tlicense"), (9, "word " * 30_000 + "MIT License"), (9, "word " * 30_000 + "MIT License"),
    (10, "all rights reserved. Copyright (c) 2020, BSD 3-Clause"), (None, "the gpl"), (11, "GNU Lesser General Public License, version 2.1"),
]


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words(text)
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def detections(text):
    """Every rule over the words, then what no other detection beats."""
    plain, found = f" {' '.join(words(text))} ", set()
    for rule in licenses.rules():
        for m in re.finditer(licenses._whole(rule.regex), plain):
            first = plain.count(" ", 0, m.start()) - 1
            found.add((first, first + m[0].count(" "), rule.priority, rule.label))

    def beaten(d):
        for e in found:
            if e[0] <= d[1] and d[0] <= e[1]:
                contains = e[0] <= d[0] and e[1] >= d[1]
                if e[2] < d[2] or e[2] == d[2] and contains and (e[1] - e[0] > d[1] - d[0] or e[3] < d[3]):
                    return True
        return False

    return sorted(d for d in found if not beaten(d))


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def check(rows):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(r.text)
        kept = detections(r.text)
        assert sorted(tuple(d) for d in r.detections) == kept
        names = {d[3] for d in kept} | {x for x in r.base_labels.split(",") if x}
        assert r.labels == ",".join(sorted(names))
        assert r.score == max([licenses.STRENGTH[d[2]] for d in kept] + [0.8] * bool(r.n_base) + [0.0])


def test_equals_brute_force(spark):
    found = licenses.scan(table(spark, TEXTS)).collect()
    assert len(found) == len(TEXTS)
    check(found)


def test_given_documents(spark):
    found = licenses.scan(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    check([r for r in found.collect() if len(r.text or "") < 3000])


@pytest.mark.parametrize("text, labels", [
    ("GNU General Public License v3 or later", "gpl,gpl-3.0-or-later"), ("under the GPLv2 only", "gpl-2.0"), ("LGPL-2.1-or-later", "lgpl-2.1-or-later"),
    ("CC BY-NC-SA 4.0", "cc-by,cc-by-nc-sa-4.0"), ("3-clause BSD license", "bsd-3-clause"), ("Mozilla Public License 2.0", "mpl-2.0"),
    ("Creative Commons Attribution-ShareAlike 3.0", "cc-by-sa-3.0"), ("Apache-2.0", "apache-2.0"), ("Unlicense", "unlicense"),
])
def test_rules(spark, text, labels):
    assert licenses.scan(table(spark, [(1, text)])).first().labels == labels


def test_every_rule_can_be_reached(spark):
    """A keyword and a stem that its own matches lack would switch a rule off."""
    known = licenses.rules()
    stems = licenses.stems(known)
    assert len(known) > 200
    for rule in known:
        sample = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", rule.regex)
        while "(?:" in sample:
            sample = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", sample)
        sample = sample.replace("[sc]", "s").replace("[0-9]{2}", "20").replace("[a-z0-9]+", "x").replace(" ?", " ").replace("v?", "v").replace("?", "")
        assert rule.keyword in sample, rule
        assert "cc" in sample or any(s in sample for s in stems), rule


def test_odd_rows(clashing, docs, odd_rows):
    found = licenses.scan(clashing)
    check(found.collect())
    assert found.count() == len(odd_rows) and "hits" in found.columns
    assert licenses.scan(docs([])).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = licenses.scan(table(spark, TEXTS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
