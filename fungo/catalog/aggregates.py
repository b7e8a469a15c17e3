"""Aggregations and reports."""

from pyspark.sql import functions as F

from fungo.catalog import query
from fungo.catalog.decisions import CAND, candidates
from fungo.functions import odds
from fungo.operators import aggregates as a
from fungo.operators.ordered import first_n_array

c = F.col
DEC = "cast({} as decimal(18,8))"


def s(x):
    return f"cast(sum({DEC.format(x)}) as double)"


def m(x):
    return f"cast(sum({DEC.format(x)}) as double) / nullif(count({x}), 0)"


@query("group_sum_count", """
select case when l_returnflag = 'N' then null else l_returnflag end as flag, l_linestatus, cast(sum(cast(l_quantity as bigint)) as bigint) as qty, count(*) as n from lineitem group by 1, 2""")
def group_sum_count(t):
    flag = F.when(c("l_returnflag") != "N", c("l_returnflag")).alias("flag")
    return t.lineitem.groupBy(flag, "l_linestatus").agg(F.sum(c("l_quantity").cast("bigint")).alias("qty"), F.count("*").alias("n"))


@query("weighted_mean", f"""
select l_suppkey, {s('l_discount * w')} / {s('case when l_discount is not null then w end')} as l_discount, {s('l_tax * w')} / {s('w')} as l_tax
from (select l_suppkey, l_tax, case when l_linenumber <> 3 then l_discount end as l_discount, greatest(l_quantity - 5, 1) as w from lineitem) x group by l_suppkey""")
def weighted_mean(t):
    df = t.lineitem.withColumns({"l_discount": F.when(c("l_linenumber") != 3, c("l_discount")), "w": c("l_quantity") - 5})
    return a.weighted_mean(df, ["l_suppkey"], ["l_discount", "l_tax"], "w")


@query("pitch_mix_weighted", f"""
select p, case when r > 1 then r / 100 else r end as rate from (
 select p, {s('rate * w')} / {s('w')} as r from (select l_partkey as p, case when l_partkey % 2 = 0 then l_discount * 100 else l_discount end as rate, greatest(l_quantity, 1) as w from lineitem) x group by p) y""")
def pitch_mix_weighted(t):
    df = t.lineitem.select(c("l_partkey").alias("p"), F.when(c("l_partkey") % 2 == 0, c("l_discount") * 100).otherwise(c("l_discount")).alias("rate"), "l_quantity")
    return a.pitch_mix_weighted(df, ["p"], "rate", "l_quantity")


@query("ratio_of_sums", """
select team, season, cast(sum(case when is_starter = 1 then outs_recorded else 0 end) as double) / nullif(sum(outs_recorded), 0) as starter_share,
 cast(sum(runs_allowed) as double) / nullif(sum(outs_recorded), 0) as runs_per_out from dated_appearances_v group by team, season""")
def ratio_of_sums(t):
    df = t.dated_appearances_v.withColumn("starter_outs", F.when(c("is_starter") == 1, c("outs_recorded")).otherwise(0))
    return a.ratio_of_sums(df, ["team", "season"], {"starter_share": ("starter_outs", "outs_recorded"), "runs_per_out": ("runs_allowed", "outs_recorded")})


@query("park_factor", """
select h.team, h.season, h.rpg / a.rpg as season_factor, avg(h.rpg / a.rpg) over (partition by h.team order by h.season rows between 3 preceding and 1 preceding) as park_factor
from (select home_team as team, season, avg(home_runs + away_runs) as rpg from games_v group by 1, 2) h
join (select away_team as team, season, avg(home_runs + away_runs) as rpg from games_v group by 1, 2) a on a.team = h.team and a.season = h.season""")
def park_factor(t):
    return a.park_factor(t.games_v)


@query("pythagorean_pct", """
select team, season, r * r / (r * r + q * q) as pyth_pct from (select team, season, cast(sum(rf) as double) as r, cast(sum(ra) as double) as q from team_games_v group by 1, 2) x""")
def pythagorean_pct(t):
    return a.pythagorean_pct(t.team_games_v)


@query("league_average", """
select season, avg(runs) as league_runs from (select game_pk, season, cast(sum(runs_allowed) as bigint) as runs from dated_appearances_v group by 1, 2) x group by season""")
def league_average(t):
    return a.league_average(t.dated_appearances_v)


@query("state_expectancy", """
select state_before, avg(total - before) as run_expectancy, count(*) as plays from (
 select state_before, sum(runs_scored) over (partition by user_id, play_date) as total,
  coalesce(sum(runs_scored) over (partition by user_id, play_date order by ts, play_id rows between unbounded preceding and 1 preceding), 0) as before from plays_v) x group by 1""")
def state_expectancy(t):
    from fungo.plans.plays import with_runs_to_end, run_expectancy
    plays = with_runs_to_end(t.plays_v, ["user_id", "play_date"], ["ts", "play_id"], cell=F.date_trunc("hour", "ts"))
    return run_expectancy(plays).withColumnRenamed("re", "run_expectancy")


_STAKED = """
select k.*, case when edge > 0.03 then cast((100 + game_pk % 900) / 100.0 as decimal(18,2)) else 0 end as stake,
 case when edge > 0.03 then case when won then round(cast((100 + game_pk % 900) / 100.0 as decimal(18,2)) * cast(net as decimal(18,6)), 2) else -cast((100 + game_pk % 900) / 100.0 as decimal(18,2)) end else 0 end as pnl,
 (game_pk % 101 - 50) / 1000.0::double as clv_prob from cand k"""


def staked(t):
    """Candidates with a flat-ish stake on edges above 3 %."""
    amount = F.when(c("edge") > 0.03, ((100 + c("game_pk") % 900) / 100).cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    df = candidates(t).withColumn("stake", amount)
    return df.withColumns({"pnl": F.when(c("stake") > 0, odds.pnl(c("stake"), c("odds"), c("won"))).otherwise(F.lit(0).cast("decimal(18,2)")),
                           "clv_prob": (c("game_pk") % 101 - 50) / 1000.0})


def _bet_sql(clv=True):
    b = lambda x: f"case when stake > 0 then {x} end"
    return (f"""count(edge) as candidate_games, count(*) filter (stake > 0) as bets, cast(count(*) filter (stake > 0) as double) / nullif(count(edge), 0) as bet_rate,
 count(*) filter (stake > 0 and won) as wins, cast(count(*) filter (stake > 0 and won) as double) / nullif(count(*) filter (stake > 0), 0) as win_rate,
 {m(b('edge'))} as avg_edge, {m(b('model_prob'))} as avg_model_prob, {m(b('market_prob'))} as avg_market_prob, {m(b('odds'))} as avg_odds,
 cast(sum(stake) as double) as staked, cast(sum(pnl) as double) as pnl, case when sum(stake) > 0 then cast(sum(pnl) as double) / cast(sum(stake) as double) end as roi""" + (f", {m(b('clv_prob'))} as avg_clv_prob" if clv else ""))


_CTX = {"cand": CAND, "st": _STAKED}


@query("bet_summary", f"select season, {_bet_sql()} from st group by season", _CTX)
def bet_summary(t):
    return staked(t).groupBy("season").agg(*a.bet_metrics())


_EDGE = """case when {0} < 0 then '<=0%' when {0} < 0.01 then '0-1%' when {0} < 0.02 then '1-2%' when {0} < 0.03 then '2-3%' when {0} < 0.05 then '3-5%' when {0} < 0.08 then '5-8%' else '8%+' end"""
_CLV = """case when {0} < -0.03 then '<-3%' when {0} < -0.01 then '-3:-1%' when {0} < 0 then '-1:0%' when {0} < 0.01 then '0:1%' when {0} < 0.03 then '1:3%' else '3%+' end"""
_DIMS = {"edge_bucket": _EDGE.format("edge"), "odds_bucket": "odds_bucket", "month": "strftime(game_date, '%Y-%m')",
         "season_phase": "season_phase", "side": "side", "favdog": "case when odds < 0 then 'favorite' else 'underdog' end",
         "sp_throws": "case game_pk % 3 when 0 then 'L' when 1 then 'R' else 'unknown' end",
         "opp_sp_throws": "case game_pk % 4 when 0 then 'L' when 1 then 'R' else 'unknown' end", "clv_bucket": _CLV.format("clv_prob")}


@query("multi_dim_report", "\nunion all ".join(
    [f"select 'total' as dimension, '' as value, {_bet_sql()} from st"] + [f"select '{n}', {e}, {_bet_sql()} from st group by 2" for n, e in _DIMS.items()]), _CTX)
def multi_dim_report(t):
    from fungo.functions.labels import season_phase
    hand = lambda n: F.when(c("game_pk") % n == 0, "L").when(c("game_pk") % n == 1, "R")
    df = staked(t).withColumns({
        "edge_bucket": a.bin_label(c("edge"), a.EDGE_BINS), "month": F.date_format("game_date", "yyyy-MM"), "season_phase": season_phase(c("game_date")),
        "favdog": F.when(c("odds") < 0, "favorite").otherwise("underdog"), "sp_throws": hand(3), "opp_sp_throws": hand(4),
        "clv_bucket": a.bin_label(c("clv_prob"), a.CLV_BINS)})
    return a.report(df, [[]] + [[n] for n in _DIMS], a.bet_metrics())


_TEAMS = """
select month, team, side, win_prob, won, '[' || printf('%.2f', k / 20.0) || ', ' || printf('%.2f', (k + 1) / 20.0) || case when k = 19 then ']' else ')' end as prob_bucket
from (select *, list_count(list_filter([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::double[], lambda e: win_prob >= e)) as k from (
 select strftime(game_date, '%Y-%m') as month, home_team as team, 'home' as side, p_model as win_prob, home_win as won from market_v
 union all select strftime(game_date, '%Y-%m'), away_team, 'away', 1 - p_model, 1 - home_win from market_v) x) y"""
_CAL = f"""count(*) as games, {m('win_prob')} as avg_pred_prob, avg(won) as actual_win_rate, avg(won) - {m('win_prob')} as calibration_error,
 abs(avg(won) - {m('win_prob')}) as abs_calibration_error, case when avg(won) - {m('win_prob')} > 0 then 'underconfident' when avg(won) - {m('win_prob')} < 0 then 'overconfident' else 'calibrated' end as direction,
 {m('((win_prob - won) * (win_prob - won))')} as brier"""
_CAL_DIMS = [["prob_bucket"], ["month"], ["team"], ["side"], ["team", "side"], ["month", "side"]]
PROB_BINS = a.equal_bins(0.0, 1.0, 20)


def _team_probs(t):
    from fungo.operators.project import symmetric
    both = symmetric(t.market_v, ["game_date"], {"team": "home_team", "win_prob": "p_model", "won": "home_win"},
                     {"team": "away_team", "win_prob": 1 - c("p_model"), "won": 1 - c("home_win")}, tag="side")
    return both.withColumns({"month": F.date_format("game_date", "yyyy-MM"), "prob_bucket": a.bin_label(c("win_prob"), PROB_BINS)})


def _cal_order(d):
    order = ["prob_bucket", "month", "team", "side"]
    return sorted(d, key=order.index)


@query("calibration_report", "\nunion all ".join(
    f"select '{'|'.join(_cal_order(d))}' as dimension, concat_ws('|', {', '.join(_cal_order(d))}) as value, {_CAL} from teams group by {', '.join(d)}" for d in _CAL_DIMS), {"teams": _TEAMS})
def calibration_report(t):
    return a.report(_team_probs(t), _CAL_DIMS, a.calibration_metrics())


@query("fixed_bins", f"""
select b.label as bucket, b.ordinal, coalesce(x.n, 0) as games, x.avg_edge from (select unnest(['<=0%', '0-1%', '1-2%', '2-3%', '3-5%', '5-8%', '8%+']) as label, unnest([0, 1, 2, 3, 4, 5, 6]) as ordinal) b
left join (select {_EDGE.format('edge')} as label, count(*) as n, {m('edge')} as avg_edge from cand group by 1) x on x.label = b.label""", {"cand": CAND})
def fixed_bins(t):
    rep = candidates(t).groupBy(a.bin_label(c("edge"), a.EDGE_BINS).alias("bucket")).agg(
        F.count("*").alias("games"), a.exact_avg(c("edge")).alias("avg_edge"))
    return a.with_empty_bins(rep, "bucket", a.EDGE_BINS, ["games"])


_CONF = (("50-55%", 0.50, 0.55), ("55-60%", 0.55, 0.60), ("60-65%", 0.60, 0.65), ("65-70%", 0.65, 0.70), ("70%+", 0.70, 1.0))


@query("right_closed_bins", """
select case when p <= 0.55 then '50-55%' when p <= 0.60 then '55-60%' when p <= 0.65 then '60-65%' when p <= 0.70 then '65-70%' else '70%+' end as bucket, count(*) as games,
 count(*) filter ((p_model > 0.5) = (home_win = 1)) as correct from (select *, greatest(p_model, 1 - p_model) as p from market_v) x where p > 0.5 and p <= 1.0 group by 1""")
def right_closed_bins(t):
    df = t.market_v.withColumn("bucket", a.bin_label(F.greatest("p_model", 1 - c("p_model")), _CONF, closed="right")).filter("bucket is not null")
    return df.groupBy("bucket").agg(F.count("*").alias("games"), F.count_if((c("p_model") > 0.5) == (c("home_win") == 1)).alias("correct"))


_FEATS = ["edge", "odds", "home_rest", "away_rest", "run_diff", "flag"]
_FEAT_SQL = """
select game_pk, side, stake, pnl, won, edge, odds, cast(game_pk % 11 as double) as home_rest, cast(game_pk % 7 as double) as away_rest,
 cast(case when game_pk % 9 = 0 then null else game_pk % 37 - 18 end as double) as run_diff, cast(game_pk % 2 as double) as flag from st where stake > 0"""
_LONG = """
select game_pk, feature, value, stake, pnl, won from (
 select game_pk, stake, pnl, won, 'edge' as feature, edge as value from ft union all select game_pk, stake, pnl, won, 'odds', odds from ft
 union all select game_pk, stake, pnl, won, 'home_rest', case when side = 'away' then away_rest else home_rest end from ft
 union all select game_pk, stake, pnl, won, 'away_rest', case when side = 'away' then home_rest else away_rest end from ft
 union all select game_pk, stake, pnl, won , 'run_diff', case when side = 'away' then -run_diff else run_diff end from ft union all select game_pk, stake, pnl, won, 'flag', flag from ft) x"""
_BINNED = """
select l.*, case when n >= 30 and d >= 3 and t0 < t1 and t1 < t2 and t2 < t3 and value is not null then case when value <= t1 then 'low' when value <= t2 then 'mid' else 'high' end end as bucket
from long l join (select feature, count(value) as n, count(distinct value) as d, min(value) as t0, max(value) as t3, quantile_cont(value, 1 / 3.0::double) as t1, quantile_cont(value, 2 / 3.0::double) as t2 from long group by 1) q on q.feature = l.feature"""
_FCTX = {**_CTX, "ft": _FEAT_SQL, "long": _LONG, "binned": _BINNED}


def _features(t):
    g = c("game_pk")
    return staked(t).filter("stake > 0").withColumns({
        "home_rest": (g % 11).cast("double"), "away_rest": (g % 7).cast("double"),
        "run_diff": F.when(g % 9 != 0, (g % 37 - 18).cast("double")), "flag": (g % 2).cast("double")})


@query("tercile_bins", "select game_pk, feature, value, bucket from binned", _FCTX)
def tercile_bins(t):
    from fungo.operators.project import side_orient, unpivot_features
    df = side_orient(_features(t), _FEATS, c("side") == "away")
    long = unpivot_features(df, ["game_pk"], _FEATS)
    return a.tercile_bins(long, ["feature"], "value")


_ROI = f"""select feature, bucket, count(*) as bets, count(*) filter (won) as wins, {m('value')} as avg_value, cast(sum(stake) as double) as staked, cast(sum(pnl) as double) as pnl,
 cast(sum(pnl) as double) / cast(sum(stake) as double) as roi from binned where bucket is not null group by 1, 2"""


def _roi(t):
    return a.feature_roi(_features(t), ["game_pk"], _FEATS, c("side") == "away")


@query("feature_roi_report", _ROI, _FCTX)
def feature_roi_report(t):
    return _roi(t)


@query("best_worst_bucket", """
select feature, arg_max(bucket, roi) as best_bucket, max(roi) as best_roi, arg_max(bets, roi) as best_bets, arg_min(bucket, roi) as worst_bucket, min(roi) as worst_roi, arg_min(bets, roi) as worst_bets,
 max(roi) - min(roi) as roi_spread, max(case when bucket = 'high' then roi end) - max(case when bucket = 'low' then roi end) as high_minus_low_roi from roi where bets >= 8 group by feature""", {**_FCTX, "roi": _ROI})
def best_worst_bucket(t):
    return a.best_worst_bucket(_roi(t))


@query("coverage_report", """
select season, count(*) as "rows", cast(count(case when game_pk % 5 <> 0 then 1 end) as double) / count(*) as home_lineup_rate, cast(count(case when game_pk % 7 <> 0 then 1 end) as double) / count(*) as away_lineup_rate from games_v group by season""")
def coverage_report(t):
    df = t.games_v.withColumns({"home_lineup": F.when(c("game_pk") % 5 != 0, 1), "away_lineup": F.when(c("game_pk") % 7 != 0, 1)})
    return a.coverage_report(df, ["season"], ["home_lineup", "away_lineup"])


@query("coverage_gaps", """
select g.game_pk, g.game_date, g.season, g.home_team, g.away_team, l.lineup, case when g.game_pk % 5 <> 0 then 1 end as home_lineup, case when g.game_pk % 7 <> 0 then 1 end as away_lineup,
 concat_ws(',', case when l.lineup is null then 'lineup' end, case when g.game_pk % 5 = 0 then 'home_lineup' end, case when g.game_pk % 7 = 0 then 'away_lineup' end) as missing
from games_v g left join (select distinct l_orderkey, 1 as lineup from lineitem) l on l.l_orderkey = g.game_pk where l.lineup is null or g.game_pk % 5 = 0 or g.game_pk % 7 = 0""")
def coverage_gaps(t):
    """Games without a lineup row or without a lineup's value for a side."""
    have = t.lineitem.select(c("l_orderkey").alias("game_pk"), F.lit(1).alias("lineup")).distinct()
    df = t.games_v.join(have, "game_pk", "left").withColumns({"home_lineup": F.when(c("game_pk") % 5 != 0, 1), "away_lineup": F.when(c("game_pk") % 7 != 0, 1)})
    return a.coverage_gaps(df, ["game_pk", "game_date", "season", "home_team", "away_team"], ["lineup", "home_lineup", "away_lineup"])


@query("year_macro_average", f"""
select model, cast(sum(games) as bigint) as games, {m('accuracy')} as avg_accuracy, {m('brier')} as avg_brier from (
 select model, season, count(*) as games, avg(case when (p >= 0.5) = (home_win = 1) then 1 else 0 end) as accuracy, {m('((p - home_win) * (p - home_win))')} as brier
 from (select 'model' as model, season, p_model as p, home_win from market_v union all select 'market', season, p_market, home_win from market_v) x group by 1, 2) y group by model""")
def year_macro_average(t):
    from fungo.ml.metrics import by_year, long_form
    per = by_year(long_form(t.market_v, ["game_pk", "season", "home_win"], {"model": "p_model", "market": "p_market"}))
    return a.year_macro_average(per, ["model"], ["accuracy", "brier"])


@query("profitable_years", """
select odds_bucket, count(*) filter (p > 0) as profitable_years, count(*) as total_years from (
 select odds_bucket, season, sum(cast(case when won then net else -1 end as decimal(18,8))) as p from cand group by 1, 2) x group by 1""", {"cand": CAND})
def profitable_years(t):
    return a.profitable_years(candidates(t), ["odds_bucket"], "season", odds.flat_profit(c("odds"), c("won")))


@query("consensus_price", f"""
select game_key, day, count(*) as books, cast(floor({s('s')} / cast(sum(n) as bigint) + 0.5) as bigint) as consensus, cast(floor({m('o')} + 0.5) as bigint) as open_price, cast(floor({m('cl')} + 0.5) as bigint) as close_price from (
 select game_key, cast(ts as date) as day, book, arg_min(price, (ts, quote_id)) as o, arg_max(price, (ts, quote_id)) as cl, {s('price')} as s, count(price) as n from quotes_v group by 1, 2, 3) x group by 1, 2""")
def consensus_price(t):
    q = t.quotes_v.withColumn("day", F.to_date("ts"))
    return a.consensus_price(q, ["game_key", "day"], "price", ["ts", "quote_id"])


@query("median_fallback", """
select d.game_pk, d.pitcher_id, coalesce(x.med, y.med) as outs from dated_appearances_v d
 left join (select team, season, median(outs_recorded) as med from dated_appearances_v where team % 5 <> 0 group by 1, 2) x on x.team = d.team and x.season = d.season
 left join (select season, median(outs_recorded) as med from dated_appearances_v where team % 5 <> 0 group by 1) y on y.season = d.season""")
def median_fallback(t):
    known = t.dated_appearances_v.filter("team % 5 <> 0")
    team = a.median(known, ["team", "season"], ["outs_recorded"]).withColumnRenamed("outs_recorded", "_team")
    league = a.median(known, ["season"], ["outs_recorded"]).withColumnRenamed("outs_recorded", "_league")
    out = t.dated_appearances_v.join(team, ["team", "season"], "left").join(league, "season", "left")
    return out.select("game_pk", "pitcher_id", F.coalesce("_team", "_league").alias("outs"))


@query("season_record", """
select season, strftime(game_date, '%Y-%m') as month, count(*) filter (stake > 0) as bets, count(*) filter (w) as wins, count(*) filter (w is null) as pending,
 cast(count(*) filter (w) as double) / nullif(count(w), 0) as win_pct, cast(sum(stake) as double) as staked, cast(sum(q) as double) as pnl, cast(sum(q) as double) / cast(sum(stake) as double) as roi,
 cast(arg_max(bankroll, (game_date, game_pk)) as double) as final_bankroll
from (select *, 1000 + sum(q) over (partition by season order by game_date, game_pk rows unbounded preceding) as bankroll
 from (select *, case when game_pk % 20 = 0 then null else won end as w, case when game_pk % 20 = 0 then 0 else pnl end as q from st where stake > 0) x) y group by 1, 2""", _CTX)
def season_record(t):
    from fungo.operators.ledger import recalculate_ledger
    book = staked(t).filter("stake > 0").withColumn("won", F.when(c("game_pk") % 20 != 0, c("won")))
    path = recalculate_ledger(book, ["season"], ["game_date", "game_pk"], 1000.0)
    return a.season_record(path.withColumn("month", F.date_format("game_date", "yyyy-MM")), ["season", "month"], ["game_date", "game_pk"])


@query("daily_accuracy", """
select game_date, count(*) as games, count(*) filter ((p_model > 0.5) = (home_win = 1)) as correct, cast(count(*) filter ((p_model > 0.5) = (home_win = 1)) as double) / count(*) as accuracy from market_v group by 1""")
def daily_accuracy(t):
    ok = F.count_if((c("p_model") > 0.5) == (c("home_win") == 1))
    return t.market_v.groupBy("game_date").agg(F.count("*").alias("games"), ok.alias("correct"), (ok / F.count("*")).alias("accuracy"))


@query("distinct_counts", """
select season, count(distinct game_pk % 97) as umpires, count(distinct home_team) as teams, count(distinct game_date) as days from games_v group by season""")
def distinct_counts(t):
    return t.games_v.groupBy("season").agg(F.countDistinct(c("game_pk") % 97).alias("umpires"), F.countDistinct("home_team").alias("teams"),
                                           F.countDistinct("game_date").alias("days"))


@query("sum_player_value", """
select pitcher_id, season, cast(sum(v) as bigint) as war from (select pitcher_id, season, outs_recorded as v from dated_appearances_v where is_starter = 1
 union all select pitcher_id, season, runs_allowed from dated_appearances_v where is_starter = 0) x group by 1, 2""")
def sum_player_value(t):
    apps = t.dated_appearances_v
    return a.sum_player_value([apps.filter("is_starter = 1").withColumn("war", c("outs_recorded")), apps.filter("is_starter = 0").withColumn("war", c("runs_allowed"))],
                              ["pitcher_id", "season"], "war")


@query("lineup_mean", f"""
select g, {m('v')} as lineup_value, count(v) as known_batters, max(n) >= 8 as confirmed from (
 select l_orderkey as g, case when l_partkey % 6 <> 0 then l_discount end as v, count(*) over (partition by l_orderkey) as n, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as slot from lineitem) x where slot <= 9 group by g""")
def lineup_mean(t):
    batters = t.lineitem.withColumnRenamed("l_orderkey", "g")
    lineups = first_n_array(batters, ["g"], ["l_linenumber", "l_partkey", "l_suppkey"], 9, F.when(c("l_partkey") % 6 != 0, c("l_discount")), "slots")
    return a.lineup_mean(lineups, ["g"], "slots")
