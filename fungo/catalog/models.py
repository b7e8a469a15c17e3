"""Splits, models, blends and metrics."""

import uuid

from pyspark.sql import functions as F

from fungo.catalog import query
from fungo.catalog.aggregates import m
from fungo.catalog.decisions import candidates
from fungo.catalog.features import _MATRIX, MATRIX_CTX
from fungo.catalog.ingest import scratch
from fungo.ml import blend, metrics, splits, train
from fungo.plans import matrix

c = F.col
FEATURES = ["rd_diff", "rs_diff", "last7_rd_diff", "streak_diff", "h2h_home_win_rate", "season_win_pct_diff", "prior_win_pct_diff"]


def feature_table(t):
    """The form matrix, written once: every fit reads it several times."""
    path = scratch(t, "features")
    rows = matrix.form_matrix(t.games_v).withColumn("home_win", c("home_win").cast("double"))
    rows.select("game_pk", "game_date", "season", "home_win", *FEATURES).write.partitionBy("season").parquet(path)
    return t.spark.read.parquet(path)


@query("walk_forward_split", """
select y.season as test_season, (select count(*) from games_v g where g.season < y.season) as train_games, (select count(*) from games_v g where g.season = y.season) as test_games
from (select distinct season from games_v where season >= (select min(season) from games_v) + 3) y""")
def walk_forward_split(t):
    g = t.games_v.groupBy("season").agg(F.count("*").alias("n"))
    parts = None
    for y in splits.test_seasons(g, least=3):
        tr, te = splits.walk_forward_split(g, "season", y)
        row = tr.agg(F.lit(y).alias("test_season"), F.sum("n").alias("train_games")).withColumn("test_games", te.agg(F.sum("n").alias("n")).scalar())
        parts = row if parts is None else parts.unionByName(row)
    return parts


@query("time_series_folds", """
select game_pk, cast(case when pos <= n - 5 * (n // 6) then -1 else (pos - 1 - (n - 5 * (n // 6))) // (n // 6) end as int) as fold
from (select game_pk, row_number() over (order by game_date, game_pk) as pos, count(*) over () as n from games_v) x""")
def time_series_folds(t):
    return splits.time_series_folds(t.games_v, ["game_date", "game_pk"], 5).select("game_pk", "fold")


@query("median_impute", """
select game_pk, coalesce(case when game_pk % 7 <> 0 then p_model end, (select median(p_model) from odds_v where game_pk % 7 <> 0)) as a, coalesce(case when game_pk % 5 <> 0 then home_ml end, (select median(home_ml) from odds_v where game_pk % 5 <> 0)) as b from odds_v""")
def median_impute(t):
    df = t.odds_v.select("game_pk", F.when(c("game_pk") % 7 != 0, c("p_model")).alias("a"), F.when(c("game_pk") % 5 != 0, c("home_ml")).alias("b"))
    return train.median_impute(df, ["a", "b"])


@query("standardize", """
select game_pk, cast(floor((p_model - a) / s * 1000000 + 0.5) as bigint) as z from odds_v, (select a, sqrt(cast(sum(cast((p_model - a) * (p_model - a) as decimal(18,8))) as double) / count(*)) as s from odds_v,
 (select cast(sum(cast(p_model as decimal(18,8))) as double) / count(*) as a from odds_v) m group by a) q""")
def standardize(t):
    out = train.standardize(t.odds_v.select("game_pk", "p_model"), ["p_model"])
    return out.select("game_pk", F.floor(c("p_model") * 1000000 + 0.5).cast("bigint").alias("z"))


@query("logistic_regression")
def logistic_regression(t):
    df = feature_table(t)
    return train.walk_forward(df, splits.test_seasons(df, least=3), train.logistic(FEATURES, weight="_w")).select("game_pk", "season", "p")


@query("gradient_boosting")
def gradient_boosting(t):
    df = feature_table(t)
    return train.walk_forward(df, splits.test_seasons(df, least=3), train.boosted_trees(FEATURES, weight="_w", trees=10)).select("game_pk", "season", "p")


@query("isotonic_calibration")
def isotonic_calibration(t):
    df = feature_table(t)
    tr, te = splits.walk_forward_split(df, "season", splits.test_seasons(df)[-1])
    return train.calibrated(train.logistic(FEATURES), tr, te, ["game_date", "game_pk"]).select("game_pk", "p")


@query("random_search")
def random_search(t):
    space = {"trees": [3, 5, 8], "depth": [2, 3], "rate": [0.05, 0.1]}
    return train.random_search(feature_table(t), FEATURES, ["game_date", "game_pk"], space, draws=2, folds=2)


@query("edge_isotonic")
def edge_isotonic(t):
    return train.edge_isotonic(candidates(t)).select("game_pk", "edge", "calibrated_prob", "calibrated_edge")


_W = {"p_model": 0.5, "p_market": 0.3, "third": 0.2, "absent": 0.4}
_WIDE = "select game_pk, season, home_win, p_model, case when game_pk % 4 <> 0 then p_market end as p_market, (p_model + p_market) / 2 as third from market_v"


def _wide(t):
    return t.market_v.select("game_pk", "season", "home_win", "p_model", F.when(c("game_pk") % 4 != 0, c("p_market")).alias("p_market"), ((c("p_model") + c("p_market")) / 2).alias("third"))


def _blend_sql(w):
    w = {k: v for k, v in w.items() if k != "absent"}
    top = "0.0::double" + "".join(f" + coalesce({k} * {v!r}::double, 0.0::double)" for k, v in w.items())
    tot = "0.0::double" + "".join(f" + case when {k} is not null then {v!r}::double else 0.0::double end" for k, v in w.items())
    return f"case when {tot} > 0 then ({top}) / ({tot}) end"


@query("weighted_blend", f"select game_pk, {_blend_sql(_W)} as p from wide", {"wide": _WIDE})
def weighted_blend(t):
    df = _wide(t)
    return df.select("game_pk", blend.weighted_blend(_W, df.columns).alias("p"))


_MODELS = ["p_model", "p_market", "third"]
_SETS = blend.weight_grid(_MODELS, _MODELS)


@query("blend_grid", "\nunion all ".join(
    f"select '{n}' as model, count(p) as games, {m('((p - home_win) * (p - home_win))')} as brier from (select home_win, {_blend_sql(w)} as p from wide) x" for n, w in _SETS.items()), {"wide": _WIDE})
def blend_grid(t):
    from fungo.operators.decision import exact_avg
    return blend.blend_grid(_wide(t), _SETS, lambda p: {"games": F.count(p), "brier": exact_avg((p - c("home_win")) * (p - c("home_win")))})


@query("stacking")
def stacking(t):
    wide = t.market_v.select("game_pk", "season", c("home_win").cast("double").alias("home_win"), "p_model", "p_market", ((c("p_model") + c("p_market")) / 2).alias("equal"))
    return train.stacking(wide, ["p_model", "p_market"], splits.test_seasons(wide, least=3), "equal").select("game_pk", "season", "p")


_MET = f"""
select model, season, count(*) as games, avg(case when (p >= 0.5) = (home_win = 1) then 1 else 0 end) as accuracy, cast(floor({m('(-case when home_win = 1 then ln(p) else ln(1 - p) end)')} * 1000000 + 0.5) as bigint) as log_loss_micro,
 {m('((p - home_win) * (p - home_win))')} as brier, {m('greatest(p, 1 - p)')} as avg_confidence from lf group by 1, 2"""
_LF = "select 'model' as model, season, p_model as p, home_win from market_v union all select 'market', season, p_market, home_win from market_v"
_AUC = """
select model, season, cast(sum(pos * (2 * coalesce(below, 0) + neg)) as double) / (2.0::double * cast(sum(pos) as bigint) * cast(sum(neg) as bigint)) as auc from (
 select model, season, p, pos, neg, sum(neg) over (partition by model, season order by p rows between unbounded preceding and 1 preceding) as below
 from (select model, season, p, count(*) filter (home_win = 1) as pos, count(*) filter (home_win = 0) as neg from lf group by 1, 2, 3) a) b group by 1, 2"""


@query("classification_metrics", f"select x.*, a.auc from ({_MET}) x join ({_AUC}) a on a.model = x.model and a.season = x.season", {"lf": _LF})
def classification_metrics(t):
    out = metrics.by_year(metrics.long_form(t.market_v, ["season", "home_win"], {"model": "p_model", "market": "p_market"}))
    return out.withColumn("log_loss_micro", F.floor(c("log_loss") * 1000000 + 0.5).cast("bigint")).drop("log_loss")


@query("calibration_curve", f"""
select model, least(cast(floor(p * 10) as int), 9) as bin, count(*) as games, {m('p')} as mean_prob, avg(home_win) as actual from lf group by 1, 2""", {"lf": _LF})
def calibration_curve(t):
    from fungo.operators.decision import exact_avg
    long = metrics.long_form(t.market_v, ["home_win"], {"model": "p_model", "market": "p_market"})
    bin_ = F.least(F.floor(c("p") * 10), F.lit(9)).cast("int").alias("bin")
    return long.groupBy("model", bin_).agg(F.count("*").alias("games"), exact_avg(c("p")).alias("mean_prob"), F.avg("home_win").alias("actual"))


@query("feature_importance")
def feature_importance(t):
    df = feature_table(t)
    model = train.boosted_trees(FEATURES, trees=10).fit(splits.walk_forward_split(df, "season", splits.test_seasons(df)[-1])[0])
    return train.feature_importance(model, FEATURES, df)


@query("ablation")
def ablation(t):
    configs = {"none": [], "meetings": ["h2h_home_win_rate"], "both": ["h2h_home_win_rate", "streak_diff"]}
    df = feature_table(t)
    return train.ablation(df, configs, FEATURES, ["h2h_home_win_rate", "streak_diff"], splits.test_seasons(df, least=4), confirm=1)


@query("market_comparison")
def market_comparison(t):
    df = feature_table(t).join(t.odds_v.select("game_pk", F.when(c("game_pk") % 4 != 0, c("p_market")).alias("market")), "game_pk")
    return train.market_comparison(df, FEATURES, "market", splits.test_seasons(df)[-1])


@query("batch_scoring")
def batch_scoring(t):
    """Requests are turned into feature rows by joins and scored together."""
    from fungo.catalog.features import _REQ
    from fungo.functions import teams
    from fungo.plans import scoring

    cols = ["rd_diff", "rs_diff", "last7_rd_diff", "streak_diff"]
    df = feature_table(t)
    model = train.logistic(cols).fit(splits.walk_forward_split(df, "season", splits.test_seasons(df)[-1])[0])
    raw = scoring.matchup_rows(t.sql(_REQ), t.games_v, t.snapshots_v, t.dated_appearances_v.filter("is_starter = 0"), teams.parks(t.spark))
    diff = lambda x: F.coalesce((c(f"home_{x}") - c(f"away_{x}")).cast("double"), F.lit(0.0))
    rows = raw.select("game_pk", diff("rolling_rd").alias("rd_diff"), diff("rolling_rs").alias("rs_diff"), diff("last7_rd").alias("last7_rd_diff"), diff("streak").alias("streak_diff"))
    return train.batch_scoring(model, rows, ["game_pk"])


@query("model_io")
def model_io(t):
    path = scratch(t, "model")
    df = feature_table(t)
    before, last = splits.walk_forward_split(df, "season", splits.test_seasons(df)[-1])
    train.save_model(train.logistic(FEATURES).fit(before), path)
    loaded = train.load_model(path)
    return train.score(loaded, last.select("game_pk", *train.feature_list(loaded))).select("game_pk", "p")


@query("artifact_manifest", """
select 'form_v1' as model_id, count(*) as rows, min(season) as first_season, max(season) as last_season, min(game_date) as first_day, max(game_date) as last_day, 7 as features
from games_v g where game_pk in (select game_pk from (""" + _MATRIX + ") q)", MATRIX_CTX)
def artifact_manifest(t):
    return train.artifact_manifest(matrix.form_matrix(t.games_v), "form_v1", FEATURES)
