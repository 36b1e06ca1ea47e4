from __future__ import annotations

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        """rows: (doc_id, text[, source])"""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, LONG), (6, LONG + " end"), (7, "a b c d e f g"), (7, "a b c d e f g"),
        (7, "other words under the same id, many of them"), (None, "no id here at all, none"), (None, None), (8, "*** !!! ###"),
        (9, "\U0001f600 é ü \x85 \xa0 x"), (10, "stupid idiot 4111 1111 1111 1111 <b>MIT License</b>", None),
    ]


@pytest.fixture(scope="session")
def clashing(docs, odd_rows):
    """The odd rows with further columns that are called like what operators make."""
    names = (
        "size", "target", "taken", "score", "copy", "n", "class", "hits", "kinds", "bands", "root", "label", "labels", "key", "bits",
        "n_words", "item_ids", "repeats", "cutoff", "_id", "_key", "held_out", "words",
    )
    return docs(odd_rows).withColumns({n: F.lit(f"own {n}") for n in names})
