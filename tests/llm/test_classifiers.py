"""Held-out accuracy, and defined results where there is little to learn from."""

import pytest
from pyspark.sql import functions as F

from lapsewise.llm import quality, toxicity

# At sf0.01 only forty toxic documents are labelled. Some labels of these tables are wrong on purpose.
FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("module, label", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, label):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = module.judge(spark.read.parquet(f"{FOLDER}/documents.parquet"), labels)
    right = found.join(labels, "doc_id").filter("held_out").agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert right[0] > 0.95 and right[1] > 500
    assert found.filter("score < 0 OR score > 1 OR score IS NULL").isEmpty()


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_few_labels(spark, clashing, odd_rows, module):
    for rows in ([], [(7, 1, 1)], [(4, None, None), (7, 0, 0), (7, 1, 1)], [(None, 1, 1), (5, 1, 1), (6, 0, 0), (7, 0, 0), (9, 1, 1), (99, 1, 1)]):
        found = module.judge(clashing, labels_of(spark, rows))
        assert found.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
        assert found.count() == len(odd_rows) and found.filter("score BETWEEN 0 AND 1").count() == len(odd_rows)
    assert module.judge(clashing.limit(0), labels_of(spark, rows)).count() == 0


def test_held_out_labels_are_not_learnt(spark, docs):
    """Turning the labels of held-out documents round changes no score."""
    rows = [(i, "good words only here" if i % 2 else "vile nasty words here") for i in range(80)]
    marks = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(80)], "doc_id bigint, quality int, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    turned = marks.select("doc_id", *[F.when(held, 1 - F.col(c)).otherwise(F.col(c)).cast("int").alias(c) for c in ("quality", "toxic")])
    for module in (toxicity, quality):
        one, two = (sorted((r.doc_id, r.score) for r in module.judge(docs(rows), m).collect()) for m in (marks, turned))
        assert one == two
    kept = toxicity.accepted(docs(rows), marks)
    assert kept.columns == docs(rows).columns and {r.doc_id % 2 for r in kept.collect()} == {1}


def test_rules_are_read_from_printed_trees():
    text = """DecisionTreeClassificationModel: uid=x, depth=2, numNodes=5, numClasses=2, numFeatures=22
  If (feature 0 <= 0.5)
   If (feature 1 > 2.5E-4)
    Predict: 1.0
   Else (feature 1 <= 2.5E-4)
    Predict: 0.0
  Else (feature 0 > 0.5)
   Predict: 1.0"""
    first, second = quality.STATISTICS[:2]
    assert [r.conditions for r in quality.rules_of(text)] == [
        ((first, False, 0.5),), ((first, False, 0.5), (second, True, 2.5e-4)), ((first, False, 0.5), (second, False, 2.5e-4)), ((first, True, 0.5),),
    ]


def test_toxic_texts_of_every_language(spark):
    """Measured on these rows, recall and precision: de 14/15 and 14/20, en 53/58 and 53/53, es 6/6 and 6/6, fr 15/18 and 15/20."""
    labels, docs = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("labels", "documents"))
    found = toxicity.judge(docs, labels).filter("held_out").select("doc_id", "predicted").join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.groupBy("lang").agg(F.sum("toxic").alias("toxic"), F.sum("predicted").alias("said"), F.expr("count_if(toxic = 1 AND predicted = 1)").alias("hit")).collect()
    assert {r.lang for r in rows} == {"de", "en", "es", "fr"}
    for r in rows:
        assert r.hit >= 0.8 * r.toxic and r.hit >= 0.65 * r.said, r
