"""Ordered, prior-only operators that do not put a whole key into one task.

A plain ``Window.partitionBy(team).orderBy(date)`` sends every row of a team to
one task. Here a key's rows are cut along the order into *cells* (by default the
first order column, usually the day) or into *blocks* of equal row count:

* ``expanding``      running aggregates: one window inside each cell, plus what
                     the earlier cells add up to. The second part runs over one
                     row per (key, cell).
* ``ranked``         position within the key, by the same split.
* ``rolling``        aggregates over the last n rows: rows are ranked, cut into
                     blocks of ``block_rows`` and each block also receives the
                     last n rows of the block before it.
* ``calendar_range`` aggregates over the last d days: one row per (key, day)
                     first, then a range frame over those.

Results equal those of the plain window. Keys must be non-null and ``order`` must
be a total order within the key.

Every operator reads its input twice, once per row and once summed per cell. In a
chain of operators that would double the work at each step, so each takes ``source``:
the frame the chain started from, with the same rows. The sums are then taken from
there and the chain stays linear.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

BLOCK_ROWS = 65_536


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _sum2(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)


def join_near(left: DataFrame, right: DataFrame, on: Sequence[str], near: Sequence[str] = ()) -> DataFrame:
    """Left join on ``on`` that moves rows by ``near`` only, those keys that ``left`` already lies by.

    The other keys are compared within a value of ``near``, of which few rows must have the
    same; they are kept out of the join's keys by comparing from both sides. All keys, if no
    ``near`` is given.
    """
    if not near:
        return left.join(right, list(on), "left")
    here, there = left.columns, right.withColumnsRenamed({k: f"_on_{k}" for k in on})
    other = lambda k: F.col(f"_on_{k}")
    same = [F.col(k) == other(k) if k in near else (F.col(k) <= other(k)) & (F.col(k) >= other(k)) for k in on]
    out = left.join(there, functools.reduce(operator.and_, same), "left")
    return out.select(*here, *[x for x in right.columns if x not in on])


# fn -> (value in the cell's window, one value per cell, merge of cells, merge of both)
_RUNNING = {
    "sum": (F.sum, lambda c, s: F.sum(c), F.sum, _sum2),
    "count": (F.count, lambda c, s: F.count(c), F.sum,
              lambda w, p: w + F.coalesce(p, F.lit(0))),
    "max": (F.max, lambda c, s: F.max(c), F.max, lambda w, p: F.greatest(w, p)),
    "min": (F.min, lambda c, s: F.min(c), F.min, lambda w, p: F.least(w, p)),
    # last non-null value in order
    "last": (lambda c: F.last(c, ignorenulls=True),
             lambda c, s: F.max_by(c, F.when(c.isNotNull(), s)),
             lambda c: F.last(c, ignorenulls=True),
             lambda w, p: F.coalesce(w, p)),
}


def expanding(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str | Column]],
    cell: str | None = None,
    inclusive: bool = False,
    source: DataFrame | None = None,
    near: Sequence[str] = (),
) -> DataFrame:
    """Add running aggregates over a key's earlier rows.

    ``aggs`` maps an output name to (sum | count | max | min | last, column).
    ``inclusive`` counts the row itself as well. ``cell`` names a column that
    never decreases along ``order``. ``near`` names those of the keys and the cell that the
    rows already lie by, so that only what is carried is moved.
    """
    cell = cell or order[0]
    on = list(dict.fromkeys([*keys, cell]))
    seq = F.struct(*[F.col(c) for c in order])
    upto = 0 if inclusive else -1
    inside = W.partitionBy(*on).orderBy(*order).rowsBetween(W.unboundedPreceding, upto)
    before = W.partitionBy(*keys).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)

    cells = (df if source is None else source).groupBy(*on).agg(
        *[_RUNNING[fn][1](_col(c), seq).alias(f"_p_{name}") for name, (fn, c) in aggs.items()]
    )
    carried = cells.select(
        *on, *[_RUNNING[fn][2](F.col(f"_p_{n}")).over(before).alias(f"_p_{n}") for n, (fn, _) in aggs.items()]
    )
    running = df.withColumns(
        {f"_w_{n}": _RUNNING[fn][0](_col(c)).over(inside) for n, (fn, c) in aggs.items()}
    )
    both = join_near(running, carried, on, near)
    out = both.withColumns(
        {n: _RUNNING[fn][3](F.col(f"_w_{n}"), F.col(f"_p_{n}")) for n, (fn, _) in aggs.items()}
    ).drop(*[f"_{t}_{n}" for n in aggs for t in "wp"])
    return out.select(*df.columns, *[n for n in aggs if n not in df.columns])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position",
           cell: str | None = None, source: DataFrame | None = None, near: Sequence[str] = ()) -> DataFrame:
    """1-based position of each row within its key."""
    return expanding(df, keys, order, {name: ("count", F.lit(1))}, cell, inclusive=True, source=source, near=near)


def expanding_prior(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                    means: Mapping[str, tuple[str | Column, int]], cell: str | None = None,
                    source: DataFrame | None = None) -> DataFrame:
    """Mean of all earlier rows of the key; null below ``min_periods`` values.

    ``means`` maps an output name to (column, min_periods).
    """
    aggs: dict[str, tuple[str, str | Column]] = {}
    for n, (c, _) in means.items():
        aggs[f"_s_{n}"] = ("sum", c)
        aggs[f"_n_{n}"] = ("count", c)
    out = expanding(df, keys, order, aggs, cell, source=source)
    return out.withColumns({
        n: F.when(F.col(f"_n_{n}") >= max(m, 1), F.col(f"_s_{n}") / F.col(f"_n_{n}"))
        for n, (_, m) in means.items()
    }).drop(*aggs)


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str],
             cols: Mapping[str, str | Column], cell: str | None = None, source: DataFrame | None = None) -> DataFrame:
    """Values of the row before, nulls included (a lag of one)."""
    row = F.struct(*[_col(c).alias(n) for n, c in cols.items()])
    out = expanding(df, keys, order, {"_prev": ("last", row)}, cell, source=source)
    return out.withColumns({n: F.col(f"_prev.{n}") for n in cols}).drop("_prev")


def _in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], span: int, cell: str | None, block_rows: int,
               source: DataFrame | None, position: str | None) -> DataFrame:
    """Rows with their 0-based place ``_at`` and ``_block``; a block also has the ``span`` rows before it, not ``_own``."""
    size = max(block_rows, span)
    at = F.col("_at")
    own, nxt = F.floor(at / size), F.floor(at / size) + 1
    homes = F.when(
        at % size >= size - span,
        F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own")),
                F.struct(nxt.alias("_block"), F.lit(False).alias("_own"))),
    ).otherwise(F.array(F.struct(own.alias("_block"), F.lit(True).alias("_own"))))
    if position is None:
        df = ranked(df, keys, order, "_pos", cell, source)
    return df.withColumn("_at", F.col(position or "_pos") - 1).select("*", F.inline(homes))


def rolling_prior(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    aggs: Mapping[str, tuple[str, str | Column, int, int]],
    cell: str | None = None,
    block_rows: int = BLOCK_ROWS,
    inclusive: bool = False,
    source: DataFrame | None = None,
    position: str | None = None,
    reset_by: Sequence[str] = (),
) -> DataFrame:
    """Aggregates over the last n rows before the current one (up to it, if ``inclusive``).

    ``aggs`` maps an output name to (avg | sum | count | min | max, column, n,
    min_periods). Null values fill a place in the frame but are not counted
    towards ``min_periods``. All frames share one sort. ``position`` names a column
    that already holds the row's 1-based place in its key. Frames start anew where a
    column of ``reset_by``, such as the season, changes; a place counts within both.
    """
    keys = [*keys, *reset_by]
    placed = _in_blocks(df, keys, order, max(n for _, _, n, _ in aggs.values()), cell, block_rows, source, position)
    w = W.partitionBy(*keys, "_block").orderBy("_at")
    fns = {"avg": F.avg, "sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    outs = {}
    for name, (fn, c, n, least) in aggs.items():
        frame = w.rowsBetween(1 - n, 0) if inclusive else w.rowsBetween(-n, -1)
        value = fns[fn](_col(c)).over(frame)
        outs[name] = value if least <= 0 else F.when(F.count(_col(c)).over(frame) >= least, value)
    return placed.withColumns(outs).filter("_own").drop("_pos", "_at", "_block", "_own")


def prefix_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    frames: Mapping[str, tuple[int, int]],
    cell: str | None = None,
    block_rows: int = BLOCK_ROWS,
    source: DataFrame | None = None,
    position: str | None = None,
) -> DataFrame:
    """Means of ``value`` over any number of frames of earlier rows, from one running sum.

    ``frames`` maps an output name to (n, min_periods): the last n rows before the current
    one. The rows of a block are summed once; a frame is the running sum one row back less
    the one n rows further back, so a row costs two lookups per frame, not n additions.
    The value must be an integer or a decimal, so that differences of sums are exact.
    """
    placed = _in_blocks(df, keys, order, max(n for n, _ in frames.values()), cell, block_rows, source, position)
    w = W.partitionBy(*keys, "_block").orderBy("_at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    kind = df.schema[value].dataType
    # a digit less than the most, so that a difference keeps its scale
    total_kind = T.DecimalType(37, kind.scale) if isinstance(kind, T.DecimalType) else T.LongType()
    summed = placed.withColumns({"_s": F.coalesce(F.sum(value).over(upto), F.lit(0)).cast(total_kind), "_c": F.count(value).over(upto)})
    back = lambda c, n: F.coalesce(F.lag(c, n).over(w), F.lit(0).cast(total_kind if c == "_s" else "bigint"))
    outs = {}
    for name, (n, least) in frames.items():
        total, count = back("_s", 1) - back("_s", n + 1), back("_c", 1) - back("_c", n + 1)
        outs[name] = F.when(count >= max(least, 1), total.cast("double") / count)
    return summed.withColumns(outs).filter("_own").drop("_pos", "_at", "_block", "_own", "_s", "_c")


def calendar_range(df: DataFrame, keys: Sequence[str], day: str,
                   aggs: Mapping[str, tuple], days: int = 0) -> DataFrame:
    """One row per (key, day) with aggregates over the days [day - days, day).

    ``aggs`` maps an output name to (sum | count | avg, column), or with a number of days
    of its own as a third entry; all share one sort.
    """
    per_day = df.groupBy(*keys, day).agg(
        *[F.sum(_col(g[1])).alias(f"_s_{n}") for n, g in aggs.items()],
        *[F.count(_col(g[1])).alias(f"_n_{n}") for n, g in aggs.items()],
    )
    ordered = W.partitionBy(*keys).orderBy(F.datediff(F.col(day), F.lit("1970-01-01").cast("date")))
    outs = []
    for n, (fn, _, *own) in aggs.items():
        w = ordered.rangeBetween(-(own[0] if own else days), -1)
        total, count = F.sum(f"_s_{n}").over(w), F.sum(f"_n_{n}").over(w)
        outs.append({"sum": total, "count": F.coalesce(count, F.lit(0)),
                     "avg": total / F.nullif(count, F.lit(0))}[fn].alias(n))
    return per_day.select(*keys, day, *outs)


def signed_streak(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                  name: str = "streak", cell: str | None = None, inclusive: bool = False,
                  source: DataFrame | None = None, counted: str | None = None) -> DataFrame:
    """Wins in a row (positive) or losses in a row (negative) going into each row.

    ``inclusive`` gives the streak after the row instead. ``counted`` names a column that
    already holds the number of non-null values up to the row, in ``df`` and ``source``.

    A value of 0 counts as a loss. After a null value the streak reads 0, but the
    run goes on behind it.
    """
    v = F.col(value)
    base = df if source is None else source
    if counted is None:
        count = {"_k": ("count", v)}
        base = expanding(base, keys, order, count, cell, inclusive=True)
        step = base if source is None else expanding(df, keys, order, count, cell, inclusive=True, source=source)
    else:
        step, base = df.withColumn("_k", F.col(counted)), base.withColumn("_k", F.col(counted))
    step = expanding(step, keys, order, {
        "_n": ("count", v),
        "_won": ("max", F.when(v > 0, F.col("_k"))),
        "_lost": ("max", F.when(v <= 0, F.col("_k"))),
        "_last": ("last", F.struct(v.alias("v"))),
    }, cell, inclusive, source=base)
    zero = F.lit(0).cast("long")
    out = (F.when(F.col("_last.v") > 0, F.col("_n") - F.coalesce("_lost", zero))
           .when(F.col("_last.v") <= 0, F.coalesce("_won", zero) - F.col("_n"))
           .otherwise(zero))
    return step.withColumn(name, out).drop("_k", "_n", "_won", "_lost", "_last")


def rest_days(df: DataFrame, keys: Sequence[str], order: Sequence[str], day: str, cap: int,
              name: str = "rest", source: DataFrame | None = None) -> DataFrame:
    """Full days off since the key's previous row, held to 0..cap."""
    out = previous(df, keys, order, {"_day": day}, source=source)
    return out.withColumn(
        name, F.when(F.col("_day").isNotNull(), F.least(F.lit(cap), F.greatest(F.lit(0), F.datediff(day, "_day") - 1)))
    ).drop("_day")


def occurrence_number(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                      name: str = "game_number", cell: str | None = None) -> DataFrame:
    """1..n within the key. ``cell`` may name a coarser order column when one key is large."""
    out = ranked(df, keys, order, name, cell)
    return out.withColumn(name, F.col(name).cast("int"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The last row of each key under ``order``; combines before the shuffle."""
    keep = list(cols) if cols else [c for c in df.columns if c not in keys]
    row = F.max_by(F.struct(*keep), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def first(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """The first row of each key under ``order``; combines before the shuffle."""
    keep = list(cols) if cols else [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*keep), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, "_row.*")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows of each key. Spark cuts each key to n rows before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= n)


def first_n_array(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, value: str | Column, name: str) -> DataFrame:
    """The first n values of each key in order, as an array of at most n."""
    rows = first_n(df, keys, order, n)
    pairs = F.array_sort(F.collect_list(F.struct("_place", _col(value).alias("v"))))
    return rows.groupBy(*keys).agg(F.transform(pairs, lambda x: x["v"]).alias(name))
