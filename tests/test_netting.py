import random
from contextlib import nullcontext

import pytest
from pyspark.sql import functions as F

from lapsewise.operators import netting
from lapsewise.operators.scans import prefix
from lapsewise.plans.catalog import QUERIES
from lapsewise.plans.handover import Handover
from replay import random_lines, remaining, remaining_before

# (rows as item, quantity, price, date), what stays of the sales under each policy
CASES = [
    ([("A", 10, 2, "2020-01-01"), ("A", -4, 2, "2020-01-05")], [6], [6]),
    ([("A", 10, 2, "2020-01-01"), ("A", -10, 2, "2020-01-05"), ("A", 5, 2, "2020-02-01")], [0, 5], [0, 5]),
    ([("A", -8, 2, "2020-01-01"), ("A", 5, 2, "2020-02-01")], [5], [5]),
    ([("A", 5, 2, "2020-01-01"), ("A", 5, 2, "2020-01-10"), ("A", -8, 2, "2020-01-15")], [0, 2], [2, 0]),
    ([("A", 5, 2, "2020-01-01"), ("A", 5, 3, "2020-01-10"), ("A", -6, 3, "2020-01-15")], [0, 4], [5, 0]),
    ([("X", 5, 2, "2020-01-01"), ("Y", 3, 4, "2020-01-01"), ("X", -5, 2, "2020-01-05")], [0, 3], [0, 3]),
    ([("A", 3, 2, "2020-01-01T10:00:00"), ("A", 4, 2, "2020-01-01T10:00:00"), ("A", -5, 2, "2020-01-05")], [0, 2], [2, 0]),
]


def left(df):
    return {r.row_seq: r.remaining_quantity for r in df.collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_hand_cases(lines, case):
    rows, *expected = CASES[case]
    df = lines([(1, item, "I", float(q), float(p), when) for item, q, p, when in rows])
    sales = [i for i, r in enumerate(rows) if r[1] > 0]
    for policy, wanted in zip(("fifo", "price_compatible"), expected):
        found = left(netting.POLICIES[policy](df))
        assert [found[i] for i in sales] == wanted
        assert all(found[i] == 0 for i in range(len(rows)) if i not in sales)


@pytest.mark.parametrize("policy", ["fifo", "price_compatible"])
@pytest.mark.parametrize("hot", [False, True])
def test_policies_against_replay(lines, blocks, policy, hot):
    # Many independent groups at once: one random history per customer block.
    rows = []
    for seed in range(12):
        rows += [(seed * 10 + r[0], *r[1:]) for r in random_lines(seed, rows=40, customers=2)]
    expected = remaining(rows, policy)
    if hot:
        with blocks(5):
            found = left(netting.POLICIES[policy](lines(rows)))
    else:
        found = left(netting.POLICIES[policy](lines(rows)))
    assert found == expected


@pytest.mark.parametrize("hot", [False, True])
def test_lifetimes_give_the_state_before_any_date(spark, lines, blocks, hot):
    rows = []
    for seed in range(20, 30):
        rows += [(seed * 10 + r[0], *r[1:]) for r in random_lines(seed, rows=40, customers=2)]
    # A price of its own per row identifies the sale a stretch belongs to.
    rows = [(*r[:4], float(i), r[5]) for i, r in enumerate(rows)]

    def lots():
        return netting.lot_lifetimes(lines(rows)).collect()

    if hot:
        with blocks(5):
            found = lots()
    else:
        found = lots()
    for cutoff in ("2021-01-05", "2021-01-12", "2021-02-01", "2021-02-09", "2021-03-01"):
        state = {}
        for r in found:
            if str(r.open_day) < cutoff and (r.close_day is None or str(r.close_day) >= cutoff):
                state[int(r.price)] = state.get(int(r.price), 0.0) + r.units
        assert state == remaining_before(rows, cutoff)


def test_price_missing(lines):
    df = lines([(1, "A", "I", 5.0, None, "2020-01-01"), (1, "A", "C", -5.0, None, "2020-01-02")])
    assert left(netting.net_newest_at_price(df)) == {0: 5.0, 1: 0.0}


def test_custom_policy(lines, blocks):
    rows = [(1, "A", "I1", 5.0, 2.0, "2020-01-01"), (1, "A", "I2", 3.0, 2.0, "2020-01-02")]
    halves = netting.net_purchases(lines(rows), lambda group: group.quantity / 2)
    assert {r.row_seq: (r.remaining_quantity, r.net_revenue) for r in halves.collect()} == {0: (2.5, 5.0), 1: (1.5, 3.0)}
    with pytest.raises(ValueError, match="policy"):
        netting.net_purchases(lines(rows), "newest")
    # Groups beyond the row limit change nothing for whole-group policies ...
    with blocks(1):
        again = netting.net_purchases(lines(rows), lambda group: group.quantity / 2)
        assert {r.row_seq: r.remaining_quantity for r in again.collect()} == {0: 2.5, 1: 1.5}


@pytest.mark.parametrize("hot", [False, True])
def test_custom_policy_as_scan(lines, blocks, hot):
    """... and policies written as scans run in blocks: here every sale keeps what its group sold before it."""
    rows = [(1, "A", f"I{i}", float(i + 1), 2.0, f"2020-01-{i + 1:02d}") for i in range(20)]

    def before(scan):
        return scan.add(_run=prefix("sum", "quantity")).with_columns(remaining_quantity=F.col("_run") - F.col("quantity"))

    def run():
        return {r.row_seq: r.remaining_quantity for r in netting.net_by_scan(before, lines(rows)).collect()}

    if hot:
        with blocks(3):
            found = run()
    else:
        found = run()
    assert found == {i: i * (i + 1) / 2 for i in range(20)}



def test_one_shuffle_and_no_python(spark, lines):
    df = lines(random_lines(1))
    for plan in (netting.net_oldest_first(df), netting.lot_lifetimes(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 1
        assert "Python" not in text and "InPandas" not in text


def test_open_lots(lines):
    df = lines([
        (1, "A", "I1", 10.0, 2.0, "2021-01-15"), (1, "A", "C1", -4.0, 2.0, "2021-03-01"),
        (1, "A", "C2", -6.0, 2.0, "2021-05-01"),
    ])
    import datetime as dt
    found = netting.open_lots(df, [dt.date(2021, 2, 1), dt.date(2021, 3, 1), dt.date(2021, 4, 1), dt.date(2021, 6, 1)])
    assert {str(r.snapshot_date): r.remaining_quantity for r in found.collect()} == {
        "2021-02-01": 10.0, "2021-03-01": 10.0, "2021-04-01": 6.0,
    }


def test_customers_without_purchase_of_all_sources(spark, lines, monkeypatch):
    rows = lines([
        (1, "A", "I1", 10.0, 2.0, "2020-01-01"), (1, "A", "C1", -4.0, 2.0, "2021-01-01"), (2, "A", "C2", -3.0, 2.0, "2020-01-01"),
        (3, "A", "I3", 5.0, 2.0, "2020-01-01"), (3, "A", "C3", -5.0, 2.0, "2021-01-01"), (4, "A", "I4", 5.0, 2.0, "2021-01-01"),
    ]).withColumn("source_sheet", F.year("invoice_date").cast("string"))
    monkeypatch.setattr(Handover, "lines", lambda self, country=False: rows)
    found = {n: sorted(r.customer_id for r in QUERIES[n](spark, "none").collect()) for n in QUERIES if n.endswith("customers_without_purchase")}
    assert found == {"customers_without_purchase": [2, 3], "newest_customers_without_purchase": [1, 3]}


@pytest.mark.parametrize("block", [None, 25])
def test_fold_equals_scan(lines, blocks, block):
    """First in, first out as a Python fold, whole groups and hot ones cut into blocks."""
    r = random.Random(11)
    made = []
    for i in range(150):
        quantity = float(r.choice((1, 2, 3, 6, -1, -2, -5)))
        customer = 1 if r.random() < 0.7 else r.randrange(2, 7)  # one group of most rows
        made.append((customer, "i" if customer == 1 else f"i{r.randrange(2)}", f"{i}", quantity, 1.0, f"2020-01-{1 + r.randrange(28):02d}"))
    table = lines(made)
    want = {x.row_seq: x.remaining_quantity for x in netting.net_oldest_first(table).collect()}
    with blocks(block) if block else nullcontext():
        got = netting.net_by_fold(netting.OLDEST_FIRST, table).collect()
    assert len(got) == 150 and {x.row_seq: x.remaining_quantity for x in got} == want


def test_fold_state_and_passes(lines, blocks):
    """A state of the caller's own making, carried over blocks, and given whole to the second pass."""
    def gather(state, block, earlier):
        return (state or []) + block["row_seq"].tolist(), None

    def place(state, block, earlier):
        return (state or 0) + len(block), block["row_seq"].map(lambda x: float(earlier.index(x))) * 100 + (state or 0)

    table = lines([(None if i % 5 == 0 else 1, "a", str(i), 1.0, 1.0, f"2020-01-{28 - i:02d}") for i in range(28)])
    with blocks(9):
        got = netting.net_by_fold(netting.Fold((gather, place)), table).collect()
    for customer in (None, 1):
        rows = sorted((x for x in got if x.customer_id == customer), key=lambda x: x.invoice_date)
        assert [int(x.remaining_quantity) // 100 for x in rows] == list(range(len(rows)))
