"""Every stage does its work on what the one before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lapsewise.llm import decontam, neardup, pii
from lapsewise.session import materialise
from llm.test_decontam import brute as contaminated
from llm.test_neardup import brute as grouped

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    tables = [spark.read.parquet(f"{FOLDER}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(materialise(stage(spark, tables[-1], FOLDER)))
    return tables


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(steps):
    assert [t.columns for t in steps[:-1]] == [COLUMNS] * 5 and steps[-1].columns[:5] == COLUMNS


def test_toxic_documents_go(spark, steps):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = set(ids(steps[0])), set(ids(steps[1]))
    known = [d for d in before if d in labels]
    assert sum((d in after) == (labels[d] == 0) for d in known) >= 0.95 * len(known)


def test_one_document_of_a_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert ids(steps[2]) == sorted({least for _, _, least in grouped(rows)})


def test_contaminated_documents_go(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert ids(steps[3]) == sorted(r.doc_id for r in steps[2].collect() if not contaminated(r.text, items)[3])


def test_personal_data_is_replaced(steps):
    key = pii.default_key(steps[3].sparkSession)
    before = {r.doc_id: r.text for r in steps[3].collect()}
    changed = 0
    for r in steps[4].collect():
        want, kinds = pii.pseudonymise(before[r.doc_id], key)
        assert r.text == want and r.n_chars == len(want)
        changed += bool(kinds)
    assert changed


def test_mix_meets_targets(steps):
    found = steps[5].groupBy("source").agg(F.sum("size").alias("words"), F.max("target").alias("target"), F.max("size").alias("largest"), F.max("copy").alias("copies")).collect()
    assert all(abs(r.words - r.target) <= r.largest and r.copies <= 2 for r in found)


def test_odd_documents(spark, clashing, odd_rows, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    tables = clashing
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, tables, str(tmp_path)))
        assert after.columns[:5] == COLUMNS
        if name != "source_mix":
            assert after.columns == clashing.columns
        empty = stage(spark, clashing.limit(0), str(tmp_path))
        assert empty.count() == 0
        tables = after
    assert neardup.near_duplicates(clashing).count() == len(odd_rows) and decontam.FOUND
