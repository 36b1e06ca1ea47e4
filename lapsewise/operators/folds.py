"""Python folds over ordered groups of any size, with carried state.

A fold goes through a group's rows in order, block by block, and hands its state on. An ordinary group is one block.
A hot group (more rows than one task may hold) is cut by order into blocks; the first blocks of
all hot groups are folded side by side, their states are written, the second blocks start from them, and so on. So a task
holds one block and one state, whatever the size of the group, and a lost executor costs one round.

A fold may have several passes: a later pass starts afresh and is given the last state of the pass before, which
lets early rows depend on what comes later (how many units are cancelled in all, say) without keeping the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from lapsewise.operators.scans import BLOCK, cut_blocks, hot_groups, spread
from lapsewise.session import materialise, written

# (state of the block before or None, rows of the block in order, last state of the earlier pass or None)
#   -> (state, one value per row or None)
Step = Callable[[object, pd.DataFrame, object], tuple[object, "pd.Series | None"]]
_STATE, _EARLIER = "_fold_state", "_fold_earlier"


class Fold(NamedTuple):
    """The passes of a fold; the values of the last one are the result. States must be picklable."""

    passes: tuple[Step, ...]


# (state so far or None, the row's columns as a tuple, last state of the earlier pass or None) -> (state, value or None)
RowStep = Callable[[object, tuple, object], tuple[object, object]]


class RowFold(NamedTuple):
    """A fold written row by row over some columns. Groups of a few rows, millions of them, cost no frame each.

    A missing value is None in a row.
    """

    columns: tuple[str, ...]
    passes: tuple[RowStep, ...]

    def by_block(self) -> Fold:
        """The same fold over blocks of rows."""

        def of(step: RowStep) -> Step:
            def run(state, frame: pd.DataFrame, earlier):
                values = []
                for row in zip(*(_listed(pa.Array.from_pandas(frame[c])) for c in self.columns)):
                    state, value = step(state, row, earlier)
                    values.append(value)
                return state, pd.Series(values, index=frame.index)

            return run

        return Fold(tuple(of(step) for step in self.passes))


def _listed(column: pa.Array) -> list:
    """Values as Python objects; numbers without gaps take the short way."""
    plain = not column.null_count and (pa.types.is_floating(column.type) or pa.types.is_integer(column.type))
    return column.to_numpy().tolist() if plain else column.to_pylist()


def _row_by_row(fold: RowFold, kept: int, name: str, kind: pa.DataType):
    """Folds the groups of a task one after the other; holds the batches of the group that is not yet complete."""

    def folded(batches: list) -> pa.RecordBatch:
        batch = pa.concat_batches(batches) if len(batches) > 1 else batches[0]
        rows = list(zip(*(_listed(batch.column(batch.schema.get_field_index(c))) for c in fold.columns)))
        firsts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 1).tolist()
        values = [None] * len(rows)
        for begin, end in zip(firsts, [*firsts[1:], len(rows)]):
            last = None
            for step in fold.passes:
                state = None
                for i in range(begin, end):
                    state, values[i] = step(state, rows[i], last)
                last = state
        names = [*batch.schema.names[:kept], name]
        return pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(values, kind)], names=names)

    def run(batches):
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            firsts = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 1)
            if not len(firsts):
                held.append(batch)
                continue
            ready = [*held, *([batch.slice(0, firsts[-1])] if firsts[-1] else [])]
            if ready:
                yield folded(ready)
            held = [batch.slice(firsts[-1])]
        if held:
            yield folded(held)

    return run


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("_fold_order", kind="stable").drop(columns="_fold_order").reset_index(drop=True)


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence, fold: Fold | RowFold, name: str, kind: str) -> DataFrame:
    """The rows with the values of the fold's last pass as a column of a SQL type."""
    df, keys = written(df), list(keys)
    hot = hot_groups(df, keys)
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    schema = T.StructType(list(df.schema.fields)).add(name, T.StructType.fromDDL(f"v {kind}")[0].dataType)

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        frame, last, values = _sorted(frame), None, None
        for step in fold.passes:
            last, values = step(None, frame.copy(), last)
        return frame.assign(**{name: values})

    def ranked(rows: DataFrame, groups: list[str]) -> DataFrame:
        # The order is settled by Spark, so that structs, nulls and times sort as they do everywhere else.
        return rows.withColumn("_fold_order", F.row_number().over(W.partitionBy(*groups).orderBy(*columns)))

    def ordinary(rows: DataFrame) -> DataFrame:
        placed = ranked(spread(rows, keys) if hot is None else rows, keys)
        if not isinstance(fold, RowFold):
            return placed.groupBy(*keys).applyInPandas(whole, schema)
        run = _row_by_row(fold, len(df.columns), name, to_arrow_type(schema[-1].dataType))
        # A window leaves its rows sorted by group and order; the place in the group comes last.
        return placed.mapInArrow(run, schema)

    if hot is None:
        return ordinary(df)
    same = F.lit(True)
    for key in keys:
        same &= df[key].eqNullSafe(hot[key])
    blocks = fold.by_block() if isinstance(fold, RowFold) else fold
    return ordinary(df.join(hot, same, "left_anti")).unionByName(
        _by_blocks(df.join(hot, same, "left_semi"), keys, columns, blocks, name, schema)
    )


def _block_step(step: Step, name: str) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = _sorted(frame)
        state, before = (None if pd.isna(frame[c].iloc[0]) else pickle.loads(frame[c].iloc[0]) for c in (_STATE, _EARLIER))
        frame = frame.drop(columns=[_STATE, _EARLIER])
        state, values = step(state, frame.copy(), before)
        # The state travels with the block's last row.
        return frame.assign(**{name: values, _STATE: [None] * (len(frame) - 1) + [pickle.dumps(state)]})

    return run


def _by_blocks(df: DataFrame, keys: list[str], order: list, fold: Fold, name: str, schema: T.StructType) -> DataFrame:
    rows = cut_blocks(df, keys, order)
    # A group's blocks follow each other: its first is round 0. One row per (hot key, block).
    blocks = rows.select(*keys, BLOCK).distinct()
    places = blocks.withColumn("_fold_round", F.row_number().over(W.partitionBy(*keys).orderBy(BLOCK)) - 1)
    same = lambda a, b, names: [a[n].eqNullSafe(b[f"_of_{n}"]) for n in names]
    places = places.withColumnsRenamed({n: f"_of_{n}" for n in [*keys, BLOCK]})
    rows = materialise(rows.join(places, same(rows, places, [*keys, BLOCK])).select(*df.columns, "_fold_round", BLOCK))
    rounds = 1 + (rows.agg(F.max("_fold_round")).first()[0] or 0)
    out = T.StructType([*schema.fields, T.StructField(_STATE, T.BinaryType())])
    earlier = None
    for number, step in enumerate(fold.passes):
        final = number == len(fold.passes) - 1

        run = _block_step(step, name)
        states, results = None, None
        for k in range(rounds):
            block = rows.filter(F.col("_fold_round") == k)
            block = block.withColumn("_fold_order", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).drop("_fold_round", BLOCK)
            for column, table in ((_STATE, states), (_EARLIER, earlier)):
                block = _with_state(block, table, keys, column)
            found = materialise(block.groupBy(*keys).applyInPandas(run, out))
            fresh = found.filter(F.col(_STATE).isNotNull()).select(*keys, _STATE)
            states = fresh if states is None else materialise(_newest(states, fresh, keys))
            if final:
                results = found.drop(_STATE) if results is None else results.unionByName(found.drop(_STATE))
        earlier = states
    return results


def _newest(states: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """States of the groups that went on, and of those that had ended before."""
    both = states.withColumn("_n", F.lit(0)).unionByName(fresh.withColumn("_n", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(_STATE, "_n").alias(_STATE))


def _with_state(rows: DataFrame, states: DataFrame | None, keys: list[str], column: str) -> DataFrame:
    if states is None:
        return rows.withColumn(column, F.lit(None).cast("binary"))
    # One row per hot group; the block's other rows need no copy of the state.
    held = states.withColumnsRenamed({k: f"_of_{k}" for k in keys} | {_STATE: column})
    same = F.col("_fold_order") == 1
    for k in keys:
        same &= rows[k].eqNullSafe(held[f"_of_{k}"])
    return rows.join(held, same, "left").drop(*[f"_of_{k}" for k in keys])
