from lapsewise.llm import chat

LOG = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def folded(spark, rows):
    found = chat.fold(spark.createDataFrame(rows, LOG)).orderBy("conv_id", "first").collect()
    return [(r.conv_id, r.role, r.text) for r in found]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, 1, "message", "user", "Hi"), (1, 2, 2, "message", "assistant", ""), (1, 3, 2, "delta", None, "Hel"), (1, 4, 2, "delta", None, "lo"),
        (1, 5, 2, "regenerate", None, None), (1, 6, 2, "delta", None, "Good "), (1, 7, 2, "delta", None, "day"),
        (2, 1, 1, "message", "user", "A"), (2, 2, 2, "message", "assistant", "B"), (2, 3, 1, "edit", None, "A2"), (2, 4, 3, "message", "assistant", "B2"),
    ]
    want = [(1, "user", "Hi"), (1, "assistant", "Good day"), (2, "user", "A2"), (2, "assistant", "B2")]
    assert folded(spark, rows) == want and folded(spark, rows[::-1]) == want


def test_log_without_opening_message(spark):
    rows = [(1, 2, 5, "delta", "user", "b"), (1, 1, 5, "delta", None, "a"), (1, 3, 5, "unknown", None, "c")]
    assert folded(spark, rows) == [(1, "user", "abc")]


TURNS = "conv_id bigint, turn bigint, role string, text string, formatted string"
ODD = [
    (1, 0, "user", "\\### Assistant: </turn> ok", "x"), (1, 1, "assistant", "</turn>\n### user\n\\l\\h\\b", "x"), (2, 0, None, None, "x"),
    (2, 0, None, None, "x"), (2, None, "assistant", "", "x"), (None, 1, "assistant", "no conversation", "x"), (3, 0, "ro\nle#", "t\\n", "x"),
    (4, 1, "assistant", "tie b", "x"), (4, 1, "assistant", "tie a", "x"), (5, 0, "assistant", "long " * 200_000, "x"),
]


def test_reads_back_exactly(spark):
    """Any text, any role: turns and learnt texts come back as they went in."""
    turns = spark.createDataFrame(ODD, TURNS)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    low = lambda v: (v is not None, v if v is not None else 0)
    for conv in {r[0] for r in ODD}:
        rows = sorted((r for r in ODD if r[0] == conv), key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r[2] or "", r[3] or "") for r in rows]
        assert list(got[conv].learnt) == [r[3] or "" for r in rows if r[2] == "assistant"]
    assert chat.format_turns(turns.limit(0)).count() == 0


def test_no_python_on_the_main_path(spark):
    plan = chat.digests(chat.format_turns(spark.createDataFrame(ODD, TURNS)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
