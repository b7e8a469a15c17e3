"""Grids of parameters and weights: one pass, no row per point, against counting by force."""

import pytest
from pyspark.sql import functions as F

from fungo.ml import blend
from fungo.operators import joins as j

ROWS = [("a", 0.01, 10), ("a", 0.05, -10), ("a", None, 5), ("b", 0.0, 7), (None, 0.09, 1)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def once(df):
    """Rows are only unpivoted above the aggregate."""
    text = plan(df)
    return text.index("Generate") < text.index("Aggregate") and text.count("Generate") == 1 and "Join" not in text


def test_grid_aggregate(spark):
    df = spark.createDataFrame(ROWS, "bucket string, edge double, profit int")
    axes = {"least": [0.0, 0.02], "sign": [1.0, -1.0]}
    out = j.grid_aggregate(df, ["bucket"], axes, lambda at: {
        "bets": F.count_if(F.col("edge") > at["least"]), "profit": F.sum(F.when(F.col("edge") > at["least"], F.col("profit") * at["sign"]))})
    want = set()
    for bucket in ("a", "b", None):
        for least in axes["least"]:
            for sign in axes["sign"]:
                on = [p * sign for b, e, p in ROWS if b == bucket and e is not None and e > least]
                want.add((bucket, least, sign, len(on), sum(on) if on else None))
    assert {tuple(r) for r in out.collect()} == want
    assert once(out)
    assert j.grid_aggregate(df.limit(0), ["bucket"], axes, lambda at: {"n": F.count("*")}).count() == 0


def test_blend_grid(spark):
    rows = [(1.0, 0.6, 0.5), (0.0, None, 0.25), (1.0, None, None)]
    df = spark.createDataFrame(rows, "y double, a double, b double")
    sets = {"only_a": {"a": 1.0}, "half": {"a": 0.5, "b": 0.5}, "unknown": {"c": 1.0}}
    found = blend.blend_grid(df, sets, lambda p: {"games": F.count(p), "total": F.sum(p)})
    got = {r.model: (r.games, r.total) for r in found.collect()}
    assert got["only_a"] == (1, pytest.approx(0.6))
    assert got["half"] == (2, pytest.approx(0.55 + 0.25))
    assert got["unknown"] == (0, None)
    assert once(found)
    empty = blend.blend_grid(df.limit(0), sets, lambda p: {"games": F.count(p)})
    assert {tuple(r) for r in empty.collect()} == {(m, 0) for m in sets}
