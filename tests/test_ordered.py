"""Two-level windows against plain windows and hand-made cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W, functions as F

from fungo.operators import aggregates as a, joins as j, ordered as o, project as p

D = lambda n: dt.date(2024, 4, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(7)
    # one team holds most rows, several games a day
    rows = [("A" if rng.random() < 0.7 else rng.choice("BC"), D(rng.randrange(40)), i, rng.choice([None, -3, -1, 0, 2, 5])) for i in range(900)]
    return spark.createDataFrame(rows, "team string, game_date date, game_pk long, run_diff int").cache()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


@pytest.mark.parametrize("block", [1, 4, 7, 65536])
def test_rolling_equals_plain_window_for_any_block_size(games, block):
    got = o.rolling_prior(games, ["team"], ["game_date", "game_pk"], {"m": ("avg", "run_diff", 4, 2), "s": ("sum", "run_diff", 3, 1)}, block_rows=block)
    w = W.partitionBy("team").orderBy("game_date", "game_pk")
    plain = games.withColumns({
        "m": F.when(F.count("run_diff").over(w.rowsBetween(-4, -1)) >= 2, F.avg("run_diff").over(w.rowsBetween(-4, -1))),
        "s": F.sum("run_diff").over(w.rowsBetween(-3, -1))})
    assert rows(got, "game_pk", "m", "s") == rows(plain, "game_pk", "m", "s")


def test_expanding_equals_plain_window(games):
    got = o.expanding(games, ["team"], ["game_date", "game_pk"], {"n": ("count", "run_diff"), "s": ("sum", "run_diff"), "hi": ("max", "run_diff"), "v": ("last", "run_diff")})
    w = W.partitionBy("team").orderBy("game_date", "game_pk").rowsBetween(W.unboundedPreceding, -1)
    plain = games.withColumns({"n": F.count("run_diff").over(w), "s": F.sum("run_diff").over(w), "hi": F.max("run_diff").over(w), "v": F.last("run_diff", True).over(w)})
    assert rows(got, "game_pk", "n", "s", "hi", "v") == rows(plain, "game_pk", "n", "s", "hi", "v")


def test_row_order_does_not_matter_and_rows_are_kept(games):
    one = o.signed_streak(games, ["team"], ["game_date", "game_pk"], "run_diff")
    two = o.signed_streak(games.orderBy(F.rand(3)), ["team"], ["game_date", "game_pk"], "run_diff")
    assert rows(one, "game_pk", "streak") == rows(two, "game_pk", "streak")
    assert one.count() == games.count()


def test_future_rows_do_not_leak(games):
    spec = {"m": ("avg", "run_diff", 4, 2)}
    cut = F.col("game_date") <= F.lit(D(20))
    base = o.rolling_prior(games, ["team"], ["game_date", "game_pk"], spec).filter(cut)
    changed = games.withColumn("run_diff", F.when(cut, F.col("run_diff")).otherwise(F.lit(99)))
    again = o.rolling_prior(changed, ["team"], ["game_date", "game_pk"], spec).filter(cut)
    assert rows(base, "game_pk", "m") == rows(again, "game_pk", "m")


def test_streak_null_score_reads_zero_but_keeps_the_run(spark):
    vals = [3, 1, -2, -4, None, -1, 0, 5]
    df = spark.createDataFrame([("A", D(i), i, v) for i, v in enumerate(vals)], "team string, game_date date, game_pk long, run_diff int")
    out = o.signed_streak(df, ["team"], ["game_date", "game_pk"], "run_diff")
    assert [r[1] for r in rows(out, "game_pk", "streak")] == [0, 1, 2, -1, -2, 0, -3, -4]


@pytest.mark.parametrize("n, value", [(4, None), (5, 2.0), (16, 8.0)])
def test_min_periods_and_frame_length(spark, n, value):
    df = spark.createDataFrame([("A", D(i), i, i) for i in range(n + 1)], "team string, game_date date, game_pk long, v int")
    out = o.rolling_prior(df, ["team"], ["game_date", "game_pk"], {"m": ("avg", "v", 15, 5)})
    assert out.filter(F.col("game_pk") == n).first()["m"] == value


def test_asof_is_inclusive_and_carries_over_cells(spark):
    snaps = spark.createDataFrame([("A", D(0), 1), ("A", D(5), 2)], "team string, snap date, n int")
    asks = spark.createDataFrame([("A", D(i)) for i in (0, 4, 5, 90)] + [("B", D(5))], "team string, day date")
    got = lambda inc: [r[2] for r in rows(j.asof_join(asks, snaps, ["team"], "day", "snap", ["n"], inclusive=inc), "team", "day", "n")]
    assert got(True) == [1, 1, 2, 2, None]
    assert got(False) == [None, 1, 1, 2, None]


def test_guard_stops_on_a_repeated_key(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert j.cardinality_guard(df.distinct(), ["k"]).count() == 2
    with pytest.raises(Exception, match="more than once"):
        j.cardinality_guard(df, ["k"]).collect()


@pytest.mark.parametrize("accuracy", [50, 20_000])
def test_exact_quantiles_with_a_coarse_sketch(spark, accuracy):
    rng = random.Random(1)
    data = {"a": [rng.gauss(0, 1) for _ in range(4000)], "b": [float(rng.randrange(5)) for _ in range(3000)]}
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "k string, v double").repartition(8)
    got = {r["k"]: (r["q1"], r["q2"]) for r in a.exact_quantiles(df, ["k"], "v", {"q1": 1 / 3, "q2": 0.5}, accuracy=accuracy).collect()}
    for k, vs in data.items():
        vs = sorted(vs)
        for p_, q in zip((1 / 3, 0.5), got[k]):
            at = (len(vs) - 1) * p_
            lo, hi = vs[int(at)], vs[min(int(at) + 1, len(vs) - 1)]
            assert q == pytest.approx(lo + (hi - lo) * (at - int(at)))


def test_tercile_skip_rules(spark):
    make = lambda vs: spark.createDataFrame([("f", float(v)) for v in vs], "feature string, value double")
    count = lambda vs: a.tercile_bins(make(vs), ["feature"], "value").filter("bucket is not null").count()
    assert count(range(29)) == 0
    assert count(range(30)) == 30
    assert count([0] * 20 + [1] * 20) == 0
    assert count([0] * 28 + [1, 2]) == 0


def test_tercile_rows_stay_where_they_are(spark):
    """No task sorts a whole key: rows meet the bounds of their key without an exchange of rows."""
    df = spark.range(0, 5000, 1, 4).selectExpr("concat('f', id % 3) as feature", "cast(id as double) as value")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = a.tercile_bins(df, ["feature"], "value")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {(r["feature"], r["bucket"]): r["count"] for r in out.groupBy("feature", "bucket").count().collect()}
    finally:
        spark.conf.set(key, before)
    assert plan.count("SortMergeJoin") <= 1  # bounds with sizes, a row per key
    assert sum(got.values()) == 5000 and len(got) == 9 and max(got.values()) - min(got.values()) <= 1


def test_bins_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(x,) for x in (-0.01, 0.0, 0.01, 0.08)], "edge double")
    lab = [r[0] for r in df.select(a.bin_label(F.col("edge"), a.EDGE_BINS)).collect()]
    assert lab == ["<=0%", "0-1%", "1-2%", "8%+"]
    rep = df.groupBy(a.bin_label(F.col("edge"), a.EDGE_BINS).alias("b")).agg(F.count("*").alias("n"))
    assert sorted((r["ordinal"], r["n"]) for r in a.with_empty_bins(rep, "b", a.EDGE_BINS, ["n"]).collect()) == [(0, 1), (1, 1), (2, 1), (3, 0), (4, 0), (5, 0), (6, 1)]
    probs = a.equal_bins(0.0, 1.0, 20)
    assert probs[3][0] == "[0.15, 0.20)" and spark.range(1).select(a.bin_label(F.lit(1.0), probs)).first()[0] == "[0.95, 1.00]"


def test_quota(spark):
    df = spark.createDataFrame([("d", i, float(i), i % 2 == 0) for i in range(11)], "day string, id int, roi double, ok boolean")
    out = p.quota_topk(df, ["day"], "roi", "id", F.col("ok"))
    assert sorted(r["id"] for r in out.filter("selected").collect()) == [6, 8, 10]
    assert out.count() == 11


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_prefix_frames_equal_plain_windows(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice("ab"), i, None if rng.random() < 0.2 else rng.randint(-10**6, 10**6)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, n int, x long").withColumn("d", (F.col("x") / 1000).cast("decimal(28,8)"))
    frames = {"f1": (1, 1), "f4": (4, 2), "f15": (15, 15), "f300": (300, 0)}
    for value in ("x", "d"):
        got = {(r.k, r.n): r for r in o.prefix_frames(df, ["k"], ["n"], value, frames, block_rows=block).collect()}
        assert len(got) == 200
        for k in "ab":
            own = sorted((n, x) for kk, n, x in rows if kk == k)
            for i, (n, _) in enumerate(own):
                for name, (size, least) in frames.items():
                    seen = [x for _, x in own[max(0, i - size):i] if x is not None]
                    want = sum(seen) / len(seen) / (1 if value == "x" else 1000) if len(seen) >= max(least, 1) else None
                    assert got[k, n][name] == (None if want is None else pytest.approx(want, rel=1e-12))


@pytest.mark.parametrize("block_rows", [1, 2, 100])
def test_frames_start_anew_by_season(spark, block_rows):
    rows = [(team, season, day, day * (3 if team == "A" else 5)) for team in "AB" for season in (2000, 2001) for day in range(1, 6)]
    df = spark.createDataFrame(rows, "team string, season int, day int, x int")
    got = o.rolling_prior(df, ["team"], ["season", "day"], {"s": ("sum", "x", 3, 1)}, block_rows=block_rows, reset_by=["season"])
    assert got.columns == [*df.columns, "s"]
    for r in got.collect():
        before = [x for t, s, d, x in rows if (t, s) == (r.team, r.season) and r.day - 3 <= d < r.day]
        assert r.s == (sum(before) if before else None)


def test_war_of_two_years_in_one_join(spark):
    people = spark.createDataFrame([(1, 2000, 7), (1, 2000, 8), (2, 2000, 9), (2, None, 7), (3, 2001, 7)], "g int, season int, who int")
    values = spark.createDataFrame([(7, 1999, 5), (7, 1998, 50), (8, 1998, 4), (9, 1997, 3), (7, None, 90)], "who int, season int, war long")
    out = j.war_fallback_join(people, values, ["g"], "season", "who", "war", "total")
    assert {r["g"]: r["total"] for r in out.collect()} == {1: 9, 2: 0, 3: 5}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 1
