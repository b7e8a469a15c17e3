"""Sequential folds.

Some results depend on every row before them in a way no aggregate can merge (a
balance rounded at each bet, runners on bases). ``ordered_fold`` deals groups over
tasks, sorts each in one shuffle and streams its rows batch by batch with one state, so
memory does not grow with a group. Groups run in parallel, a group does not: choose
groups that are short by nature, such as a game or an account's season.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def _whole(values: Sequence) -> pd.Series:
    """A column of exact values: integers beside nulls are not made floats."""
    return pd.Series(list(values), dtype=object)


def ordered_fold(df: DataFrame, group: Sequence[str], order: Sequence[str], inputs: Sequence[str],
                 step: Callable[[tuple, tuple], tuple[tuple, tuple]], outputs: Mapping[str, str], initial: tuple) -> DataFrame:
    """Add ``outputs`` and ``_pos``, the position in the group from 1, by calling ``step(state, inputs) -> (state, outputs)`` on each row in order.

    ``outputs`` maps a column name to its type; every group starts from ``initial``.
    """
    group, results = list(group), list(outputs)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    schema = ", ".join([*fields, "`_pos` bigint", *(f"`{n}` {t}" for n, t in outputs.items())])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now, at = None, initial, 0
        for pdf in batches:
            made = []
            for k, row in zip(zip(*[pdf[g] for g in group]), zip(*[pdf[i] for i in inputs])):
                if k != key:
                    key, now, at = k, initial, 0
                now, out = step(now, row)
                at += 1
                made.append((at, *out))
            columns = zip(*made) if made else [[] for _ in range(len(results) + 1)]
            yield pdf.assign(**{n: _whole(v).set_axis(pdf.index) for n, v in zip(["_pos", *results], columns)})

    return df.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(walk, schema)


def ordered_end(df: DataFrame, group: Sequence[str], order: Sequence[str], inputs: Sequence[str],
                step: Callable[[tuple, tuple], tuple], outputs: Mapping[str, str], initial: tuple, finish: Callable[[tuple], tuple]) -> DataFrame:
    """One row per group: ``finish`` of the state that ``step(state, inputs) -> state`` leaves after the group's last row.

    Only the columns named are moved, and no row per input row is made; otherwise as ``ordered_fold``.
    """
    group = list(group)
    schema = ", ".join([*(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in group), *(f"`{n}` {t}" for n, t in outputs.items())])
    made = lambda key, state: pd.DataFrame({n: _whole([v]) for n, v in zip([*group, *outputs], [*key, *finish(state)])})
    # nulls are one key, not a NaN that differs from itself
    keys = lambda column: column.astype(object).where(column.notna(), None)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, now = None, initial
        for pdf in batches:
            for k, row in zip(zip(*[keys(pdf[g]) for g in group]), zip(*[pdf[i] for i in inputs])):
                if k != key:
                    if key is not None:
                        yield made(key, now)
                    key, now = k, initial
                now = step(now, row)
        if key is not None:
            yield made(key, now)

    few = df.select(*dict.fromkeys([*group, *order, *inputs]))
    return few.repartition(*group).sortWithinPartitions(*group, *order).mapInPandas(walk, schema)
