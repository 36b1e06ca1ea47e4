from lapsewise.llm import mixing


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def test_water_filling_by_hand(spark):
    """Weights 5, 2, 1 for a, b, c of 10, 100, 100 words: a stops at 20, the rest goes 2 : 1."""
    sources = spark.createDataFrame([("a", 10, 5), ("b", 100, 2), ("c", 100, 1)], "source string, source_size bigint, weight int")
    found = {r.source: r.target for r in mixing.water_fill(sources, 1.5, 2.0).collect()}
    assert found["a"] == 20 and abs(found["b"] - 295 * 2 / 3) < 1e-9 and abs(found["c"] - 295 / 3) < 1e-9


def test_taken_words_meet_targets(docs):
    rows = [(i, "w " * (1 + i * 7 % 23), f"s{i % 5}") for i in range(800)]
    found = mixing.mix(docs(rows)).collect()
    for source in {r.source for r in found}:
        mine = [r for r in found if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 12
        assert all(r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0) for r in mine)
    assert abs(sum({r.source: r.target for r in found}.values()) - 1.5 * sum(r.size for r in found)) < 1e-6
    again = mixing.mix(docs(rows[::-1]).repartition(3))
    assert rows_of(again) == sorted([(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in found], key=str)
    other = mixing.mix(docs(rows), seed="another")
    assert rows_of(other) != rows_of(again)


def test_repetitions_are_the_taken_words(docs):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(200)]
    mixed = {r.doc_id: r.taken for r in mixing.mix(docs(rows)).collect()}
    copies = mixing.repeated(docs(rows)).collect()
    for doc, taken in mixed.items():
        mine = [r for r in copies if r.doc_id == doc]
        assert sum(r.size for r in mine) == taken and sorted(r.copy for r in mine) == list(range(1, len(mine) + 1))


def test_odd_rows(clashing, docs):
    found = mixing.mix(clashing)
    assert found.count() == clashing.count()
    assert {r.doc_id: r.size for r in found.collect()}[1] == 0
    assert "repeats" in mixing.repeated(clashing).columns
    assert mixing.mix(docs([])).count() == 0 and mixing.repeated(docs([])).count() == 0
    only_empty = mixing.mix(docs([(1, ""), (2, None)])).collect()
    assert [(r.target, r.taken) for r in only_empty] == [(0.0, 0), (0.0, 0)]


def test_no_copies_of_texts_without_words(docs):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", "x"), (4, " \t", "y"), (5, "d", "y")]
    found = mixing.repeated(docs(rows)).collect()
    assert {r.doc_id for r in found} <= {1, 5} and all(r.size > 0 for r in found)
