"""Run catalogue queries and their SQL twins on one folder and compare all values.

    python tests/twin_check.py <folder> [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if value is None:
        return "null"
    return f"{type(value).__name__}:{value}"


def compare(df, con, sql: str) -> str | None:
    """None when equal; otherwise what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: spark only {sorted(set(df.columns) - set(names))}, sql only {sorted(set(names) - set(df.columns))}"
    mine = [tuple(r[n] for n in sorted(names)) for r in df.collect()]
    order = [names.index(n) for n in sorted(names)]
    a = sorted(tuple(_cell(v) for v in r) for r in mine)
    b = sorted(tuple(_cell(r[i]) for i in order) for r in theirs)
    if len(a) != len(b):
        return f"rows differ: {len(a)} / {len(b)}; spark {a[:1]} sql {b[:1]}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if not wrong:
        return None
    x, y = wrong[0]
    fields = {n: (p, q) for n, p, q in zip(sorted(names), x, y) if p != q}
    return f"{len(wrong)} of {len(a)} rows differ, first: {fields}"


def main() -> int:
    from lapsewise.plans.catalog import QUERIES
    from lapsewise.plans.twins import TWINS
    from lapsewise.session import local_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(8), database(folder), 0
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        begun = time.time()
        if name not in TWINS:
            problem, tag = None, "no twin"
            rows = QUERIES[name](spark, folder).count()
            tag += f", {rows} rows"
        else:
            try:
                problem = compare(QUERIES[name](spark, folder), con, TWINS[name])
            except Exception as error:  # report and go on with the other queries
                problem = f"{type(error).__name__}: {str(error)[:400]}"
            tag = "equal" if problem is None else "DIFFERS"
        bad += problem is not None
        print(f"{name:32s} {time.time() - begun:6.1f}s {tag} {problem or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
