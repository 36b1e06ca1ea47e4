import random

import pytest
from pyspark.sql import functions as F

from lapsewise.operators.scans import lag, lead, ordered_scan, position, prefix, suffix, total


def all_steps(scan):
    return scan.add(
        place=position(), run=prefix("sum", "v"), low=prefix("min", "v"), high=prefix("max", "v"),
        rest=suffix("sum", "v"), floor=suffix("min", "v"), whole=total("sum", "v"), top=total("max", "v"),
        seen=prefix("last", "maybe"), before=lag("v"), after=lead("v"),
    ).df


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    # Group "a" holds most of the rows.
    data = [(("a" if rng.random() < 0.7 else rng.choice("bcd")), i, float(rng.randint(-5, 9)),
             rng.choice([None, float(i)])) for i in range(300)]
    return spark.createDataFrame(data, "k string, o int, v double, maybe double").repartition(5)


def collected(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("descending", [False, True])
def test_blocks_equal_plain_windows(rows, blocks, keys, descending):
    order = [F.col("o").desc() if descending else F.col("o")]
    expected = collected(ordered_scan(rows, keys, order, all_steps))
    with blocks(20):
        found = ordered_scan(rows, keys, order, all_steps)
        assert "_block" not in found.columns
        assert collected(found) == expected


def test_hot_rows_are_spread(rows, blocks):
    seen = {}

    def run(scan):
        if scan.blocked:
            seen["blocks"] = scan.df.groupBy("_block").count().collect()
        return all_steps(scan)

    with blocks(20):
        ordered_scan(rows, ["k"], ["o"], run).count()
    sizes = [r["count"] for r in seen["blocks"]]
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 3


def test_reordered_scan(rows, blocks):
    def run(scan):
        scan = scan.add(run=prefix("sum", "v"))
        flipped = scan.reordered(scan.df, F.col("o").desc())
        return flipped.add(back=prefix("sum", "run")).df

    expected = collected(ordered_scan(rows, ["k"], ["o"], run))
    with blocks(20):
        assert collected(ordered_scan(rows, ["k"], ["o"], run).drop("_block")) == expected
