"""Hard negatives against all scores by force, bounds against true angles, and awkward rows."""

import numpy as np
import pytest

from fungo.llm import negatives

DDL = "vec_id long, label int, embedding array<float>, rank string"


def some_rows():
    rng = np.random.default_rng(5)
    middle = rng.normal(0, 0.3, (6, 9))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in middle[i % 6] + rng.normal(0, 0.1, 9)], "x") for i in range(260)]
    rows += [(300 + i, i % 2, [0.25] * 9, "x") for i in range(40)]  # ties
    rows += [(400, 1, None, "x"), (401, 1, [1.0, None], "x"), (402, 1, [float("nan")] * 9, "x"), (403, 1, [], "x"), (None, 1, [1.0] * 9, "x"), (404, None, [1.0] * 9, "x"),
             (405, 2, [0.5] * 4, "x"), (406, 2, [0.0] * 9, "x"), (410, 3, [0.0] * 9, "x"), rows[10], (20, 3, [0.125] * 9, "x"), (30, rows[30][1], [-0.5] * 9, "x")]
    return rows


def by_force(rows, every, scale, k_pos, k_neg, low, high):
    live = {(i, y, tuple(int(np.floor(scale * float(np.float32(x)))) for x in v)) for i, y, v, _ in rows
            if i is not None and y is not None and v and None not in v and np.isfinite(v).all()}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, y, v in live:
        if a % every == 0:
            others = [(-dot(v, u), i, z) for i, z, u in live if i != a]
            for s, p, z in sorted(o for o in others if o[2] == y)[:k_pos]:
                fit = sorted(o for o in others if o[2] != y and low * -s <= 100 * -o[0] <= high * -s)[:k_neg]
                out += [(a, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("every,scale,k_pos,k_neg,low,high", [(10, 256, 5, 5, 80, 100), (5, 64, 3, 2, 50, 95), (7, 1 << 30, 2, 4, -20, 120)])
def test_matches_force(spark, monkeypatch, every, scale, k_pos, k_neg, low, high):
    for name, value in (("ANCHORS", 12), ("SEED", 50), ("BLOCK", 7), ("PART", 60), ("REFERENCES", 5)):
        monkeypatch.setattr(negatives, name, value)
    rows = some_rows()
    got = negatives.mined(spark.createDataFrame(rows, DDL), f"vec_id % {every} = 0", k_pos, k_neg, low, high, scale)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == by_force(rows, every, scale, k_pos, k_neg, low, high)


def test_bounds_hold(spark):
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(0, 1, (400, 6)) * rng.choice([3, 300, 1e6], (400, 1))).astype(np.int64)
    v[:40] = v[40:80]
    v[80:90] = -v[90:100]
    v[100] = 0
    d = negatives.references(v, 5)
    assert np.allclose(negatives.norms(d), 1) and len(d) == 5
    t, n = negatives.angles(v, d), negatives.norms(v)
    low, high = negatives.score_bounds(*negatives.apart(t, t, t), *[n[:, None] * n] * 2)
    scores = v.astype(object) @ v.T.astype(object)
    assert (low <= scores).all() and (scores <= high).all()
    # the intervals tell something: some pairs of rows are out of reach of half the product of norms
    assert (high < 0.5 * n[:, None] * n).mean() > 0.1
    block = slice(200, 260)
    low, high = negatives.score_bounds(*negatives.apart(t, t[block].min(axis=0)[None], t[block].max(axis=0)[None]), n[:, None] * n[block].min(), n[:, None] * n[block].max())
    assert (low <= scores[:, block]).all() and (scores[:, block] <= high).all()


def test_awkward_tables(spark):
    assert negatives.mined(spark.createDataFrame([], DDL), "true").count() == 0
    none = spark.createDataFrame([(1, None, [1.0], "x"), (2, 1, None, "x")], DDL)
    assert negatives.mined(none, "true").count() == 0
    zero = spark.createDataFrame([(1, 0, [0.0], "x"), (2, 0, [0.0], "x"), (3, 1, [0.0], "x")], DDL)
    assert sorted(map(tuple, negatives.mined(zero, "true").collect())) == [(1, 2, 1, 3, 0, 0), (2, 1, 1, 3, 0, 0)]
    huge = spark.createDataFrame([(1, 0, [1e30], "x"), (2, 0, [1e30], "x")], DDL)
    with pytest.raises(Exception, match="beyond 64 bits"):
        negatives.mined(huge, "true").collect()
