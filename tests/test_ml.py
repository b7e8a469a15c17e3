"""Models: the optimum of a fit, what calibration promises, and reloading."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fungo.ml import train


@pytest.fixture(scope="module")
def games(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        a, b = rng.gauss(0, 1), rng.gauss(2, 3)
        rows.append((i, 1998 + i // 100, a, b, int(rng.random() < 1 / (1 + math.exp(-(0.8 * a - 0.3 * (b - 2)))))))
    return spark.createDataFrame(rows, "game_pk long, season int, a double, b double, home_win int").coalesce(2).cache()


def log_loss(rows):
    return -sum(math.log(r.p if r.home_win else 1 - r.p) for r in rows) / len(rows)


def test_logistic_is_at_its_optimum(games):
    model = train.logistic(["a", "b"]).fit(games)
    rows = train.score(model, games).collect()
    n = len(rows)
    assert abs(sum(r.p - r.home_win for r in rows)) / n < 1e-4
    for x in ("a", "b"):  # the penalty is 1e-4 per standard deviation
        mean = sum(r[x] for r in rows) / n
        assert abs(sum((r.p - r.home_win) * (r[x] - mean) for r in rows)) / n < 2e-3
    share = sum(r.home_win for r in rows) / n
    assert log_loss(rows) < -(share * math.log(share) + (1 - share) * math.log(1 - share)) - 0.05


def test_walk_forward_never_sees_the_year_it_scores(games):
    got = {r.game_pk: r.p for r in train.walk_forward(games, [2000, 2001], train.logistic(["a", "b"], weight="_w")).collect()}
    assert sorted(got) == list(range(200, 400))
    flipped = games.withColumn("home_win", F.when(F.col("season") == 2001, 1 - F.col("home_win")).otherwise(F.col("home_win")))
    again = {r.game_pk: r.p for r in train.walk_forward(flipped, [2000, 2001], train.logistic(["a", "b"], weight="_w")).collect()}
    assert got == pytest.approx(again, rel=1e-9)


def test_trees_and_importance(games):
    model = train.boosted_trees(["a", "b"], trees=5, sample=1.0).fit(games)
    assert log_loss(train.score(model, games).collect()) < 0.69
    got = train.feature_importance(model, ["a", "b"], games).collect()
    assert {r.feature for r in got} == {"a", "b"} and [r.place for r in got] == [1, 2]


def test_reloaded_model_scores_alike(games, tmp_path):
    model = train.logistic(["a", "b"]).fit(games)
    train.save_model(model, str(tmp_path / "m"))
    again = train.load_model(str(tmp_path / "m"))
    assert train.feature_list(again) == ["a", "b"]
    assert train.score(model, games).select("game_pk", "p").exceptAll(train.score(again, games).select("game_pk", "p")).isEmpty()


def test_edge_curve_is_the_isotonic_regression(spark):
    rng = random.Random(9)
    rows = [(i, round(-0.1 + i / 200, 4), 0.5, rng.random() < 0.4 + i / 200) for i in range(60)]
    got = train.edge_isotonic(spark.createDataFrame(rows, "game_pk long, edge double, market_prob double, won boolean")).orderBy("edge").collect()
    blocks = []  # pool neighbours until means rise
    for _, _, m, won in rows:
        blocks.append([float(won) - m, 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
    want = [max(-0.2, min(0.2, s / n)) for s, n in blocks for _ in range(n)]
    assert [r.calibrated_edge for r in got] == pytest.approx(want, abs=1e-9)


def test_calibrated_probabilities_follow_the_model(games):
    held, rest = games.where("season = 2001"), games.where("season < 2001")
    got = train.calibrated(train.logistic(["a", "b"]), rest, held, ["season", "game_pk"], folds=2).collect()
    assert len(got) == 100 and all(0 <= r.p <= 1 for r in got)
    assert sum(abs(r.p - r.home_win) for r in got) / 100 < 0.5


def test_random_search_ranks_draws_by_log_loss(games):
    got = train.random_search(games, ["a", "b"], ["season", "game_pk"], {"trees": [2, 3], "depth": [2], "rate": [0.1]}, draws=2, folds=2).collect()
    assert len(got) == 2 and all(r.folds == 2 for r in got) and got[0].mean_log_loss <= got[1].mean_log_loss < 0.72


def test_years_read_the_table_once(spark, games, tmp_path):
    """However many years are fitted, the table's files are scanned once."""
    games.write.parquet(str(tmp_path / "t"))
    scans = {}
    for years in ([2001], [1999, 2000, 2001]):
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        df = spark.read.parquet(str(tmp_path / "t"))
        out = train.walk_forward(df.mapInArrow(count, df.schema), years, train.logistic(["a", "b"], weight="_w"))
        assert out.count() == 100 * len(years)
        scans[len(years)] = seen.value
    assert scans == {1: 400, 3: 400}


def test_stacking_weighs_and_falls_back(games):
    wide = games.select("game_pk", "season", "home_win", (1 / (1 + F.exp(-F.col("a")))).alias("m"), F.lit(0.5).alias("equal"))
    got = {r.game_pk: (r.season, r.p) for r in train.stacking(wide, ["m"], [1999, 2000, 2001], "equal").collect()}
    assert sorted(got) == list(range(100, 400)) and all(p == 0.5 for s, p in got.values() if s == 1999)
    alone = train.logistic(["m"], c=0.5).fit(wide.where("season = 1999"))
    want = {r.game_pk: r.p for r in train.score(alone, wide.where("season = 2000")).collect()}
    assert {g: p for g, (s, p) in got.items() if s == 2000} == pytest.approx(want, rel=1e-6)


def test_ablation_zeroes_what_a_configuration_leaves_out(games):
    got = {(r.stage, r.config): r for r in train.ablation(games, {"none": [], "all": ["a", "b"]}, ["a", "b"], ["a", "b"], [2000, 2001], confirm=1).collect()}
    assert set(got) == {("screen", "none"), ("screen", "all"), ("confirm", "all")}
    assert got["screen", "all"].avg_log_loss < got["screen", "none"].avg_log_loss and got["screen", "none"].avg_auc == pytest.approx(0.5)


def test_market_comparison_has_every_model_and_subset(games):
    df = games.withColumn("market", F.when(F.col("game_pk") % 2 == 0, 1 / (1 + F.exp(-F.col("a")))))
    got = {(r.model, r.subset): r.games for r in train.market_comparison(df, ["a", "b"], "market", 2001).collect()}
    assert got == {("blind", "all"): 100, ("aware", "all"): 100, ("blind", "with odds"): 50, ("aware", "with odds"): 50, ("market", "with odds"): 50}


def test_kept_tables_are_files(spark):
    """Concurrent fits read files; no plan with subqueries or running stages goes along with their jobs."""
    n = spark.range(3).groupBy().count().scalar()
    kept = train.held(spark.range(5).withColumn("n", n).withColumn("x", F.lit(1.5)))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "InMemoryTableScan" not in plan and "Subquery" not in plan
    assert sorted(tuple(r) for r in kept.collect()) == [(i, 3, 1.5) for i in range(5)]


def test_ablation_confirms_with_the_probabilities_of_the_screen(games, monkeypatch):
    calls, fit = [], train.walk_forward
    monkeypatch.setattr(train, "walk_forward", lambda *a, **k: calls.append(1) or fit(*a, **k))
    out = train.ablation(games, {"none": [], "b": ["b"]}, ["a", "b"], ["b"], [2000, 2001], confirm=1).collect()
    assert len(calls) == 3  # two regressions and the trees of the best
    assert sorted((r["stage"], r["games"]) for r in out) == [("confirm", 200), ("screen", 200), ("screen", 200)]
