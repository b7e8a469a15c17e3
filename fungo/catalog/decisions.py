"""Decision and ledger operators."""

from pyspark.sql import functions as F

from fungo.catalog import query
from fungo.functions import odds
from fungo.operators import decision as d, ledger as l, project as p

c = F.col
cents = lambda x: (c(x) * 100).cast("bigint")

_BUCKET = """case when {0} < -180 then '<-180' when {0} < -140 then '-180:-140' when {0} < -115 then '-140:-115'
 when {0} < 100 then '-115:+100' when {0} < 130 then '+100:+130' when {0} < 170 then '+130:+170' else '+170+' end"""

CAND = f"""
select m.*, {_BUCKET.format('odds')} as odds_bucket, case when month(game_date) <= 4 then 'early' when month(game_date) >= 9 then 'late' else 'mid' end as season_phase,
 case when odds > 0 then odds / 100 else 100 / abs(odds) end as net
from (select x.*, case when h then 'home' else 'away' end as side, case when h then p_model else 1 - p_model end as model_prob,
  case when h then p_market else 1 - p_market end as market_prob, case when h then home_ml else away_ml end as odds,
  case when h then p_model - p_market else (1 - p_model) - (1 - p_market) end as edge, (home_win = 1) = h as won
 from (select *, p_model - p_market >= (1 - p_model) - (1 - p_market) as h from market_v) x) m"""

_RULES = [("+130:+170", "all", 0.04, 0.0), ("+130:+170", "late", 0.02, 0.0), ("-115:+100", "early", 0.03, 0.45), ("all", "mid", 0.05, 0.4),
          ("<-180", "all", 0.01, 0.7), ("+100:+130", "early", 0.02, 0.0)]
RULES_SQL = "select * from (values " + ", ".join(f"('{b}', '{f}', {e}::double, {m}::double)" for b, f, e, m in _RULES) + ") v(bucket, phase, min_edge, min_model_prob)"

DECIDED = """
select k.*, case when min_edge is null then odds_bucket || ' excluded by tuned'
  when model_prob < min_model_prob then 'model prob < ' || cast(floor(min_model_prob * 100 + 0.5) as bigint) || '%'
  when edge > min_edge then 'tuned: ' || odds_bucket || ' edge > ' || cast(floor(min_edge * 100 + 0.5) as bigint) || '%'
  else 'edge <= ' || cast(floor(min_edge * 100 + 0.5) as bigint) || '% threshold' end as policy_reason,
 coalesce(model_prob >= min_model_prob and edge > min_edge, false) as should_bet
from (select c.*, coalesce(r1.min_edge, r2.min_edge, r3.min_edge, r4.min_edge) as min_edge,
  case when r1.bucket is not null then r1.min_model_prob when r2.bucket is not null then r2.min_model_prob when r3.bucket is not null then r3.min_model_prob else r4.min_model_prob end as min_model_prob
 from cand c left join rules r1 on r1.bucket = odds_bucket and r1.phase = season_phase
  left join rules r2 on r2.bucket = odds_bucket and r2.phase = 'all' left join rules r3 on r3.bucket = 'all' and r3.phase = season_phase
  left join rules r4 on r4.bucket = 'all' and r4.phase = 'all') k"""
_KELLY = "case when net > 0 and model_prob * net - (1 - model_prob) > 0 then least({f} * ((model_prob * net - (1 - model_prob)) / net), {c}) else 0.0 end::double"


def candidates(t):
    return d.choose_side(t.market_v).withColumn("odds_bucket", odds.odds_bucket(c("odds")))


def rules(t):
    rows = [(b, f, e, m, i) for i, (b, f, e, m) in enumerate(_RULES)]
    return t.spark.createDataFrame(rows, "bucket string, season_phase string, min_edge double, min_model_prob double, position int")


def decided(t):
    return d.apply_policy(d.choose_side(t.market_v), rules(t), policy="tuned")


@query("choose_side", "select game_pk, side, model_prob, market_prob, odds, edge, won from cand", {"cand": CAND})
def choose_side(t):
    return d.choose_side(t.market_v).select("game_pk", "side", "model_prob", "market_prob", "odds", "edge", "won")


@query("resolve_policy_rule", "select game_pk, odds_bucket, season_phase, min_edge, min_model_prob from decided",
       {"cand": CAND, "rules": RULES_SQL, "decided": DECIDED})
def resolve_policy_rule(t):
    return decided(t).select("game_pk", "odds_bucket", "season_phase", "min_edge", "min_model_prob")


@query("evaluate_candidate", "select game_pk, should_bet, policy_reason from decided", {"cand": CAND, "rules": RULES_SQL, "decided": DECIDED})
def evaluate_candidate(t):
    return decided(t).select("game_pk", "should_bet", "policy_reason")


_VARIANTS = {"quarter_10": (0.25, 0.10), "quarter_5": (0.25, 0.05), "half_10": (0.5, 0.10), "full_2": (1.0, 0.02)}


@query("kelly_fraction", "select game_pk, " + ", ".join(f"{_KELLY.format(f=f'{f}::double', c=f'{k}::double')} as {n}" for n, (f, k) in _VARIANTS.items()) + " from cand", {"cand": CAND})
def kelly_fraction(t):
    return candidates(t).select("game_pk", *[odds.kelly_fraction(c("model_prob"), c("odds"), f, k).alias(n) for n, (f, k) in _VARIANTS.items()])


_PNL = "case when won then round({s} * cast(net as decimal(18,6)), 2) else -({s}) end"


@query("pnl_from_odds", f"""
select game_pk, cast((case when game_pk % 10 = 0 then 0 else {_PNL.format(s='s')} end) * 100 as bigint) as pnl_cents
from (select *, cast((100 + game_pk % 4900) / 100.0 as decimal(18,2)) as s from cand) x""", {"cand": CAND})
def pnl_from_odds(t):
    stake = ((100 + c("game_pk") % 4900) / 100).cast("decimal(18,2)")
    won = F.when(c("game_pk") % 10 != 0, c("won"))
    return candidates(t).withColumn("pnl", odds.pnl(stake, c("odds"), won)).select("game_pk", cents("pnl").alias("pnl_cents"))


_FOLD = """
with recursive {views} bets as (select season, row_number() over (partition by season order by game_date, game_pk) as pos, game_pk, won,
  cast(floor({share} * 100000000 + 0.5) as hugeint) as s, cast(floor(net * 1000000 + 0.5) as hugeint) as n from {src}),
walk as (select season, 0::bigint as pos, 0::bigint as game_pk, 0::hugeint as stake, 0::hugeint as pnl, 10000::hugeint as bal from (select distinct season from bets) q
 union all
 select b.season, b.pos, b.game_pk, k.st, case when b.won then (2 * k.st * b.n + 1000000) // 2000000 else -k.st end,
  w.bal + case when b.won then (2 * k.st * b.n + 1000000) // 2000000 else -k.st end
 from walk w join bets b on b.season = w.season and b.pos = w.pos + 1, lateral (select (2 * w.bal * b.s + 100000000) // 200000000 as st) k)
select game_pk, cast(stake as bigint) as stake_cents, cast(pnl as bigint) as pnl_cents, cast(bal as bigint) as bankroll_cents from walk where pos > 0"""


def _fold_sql():
    from fungo.views import oracle
    head = oracle("select 1 from decided", {"cand": CAND, "rules": RULES_SQL, "decided": DECIDED})
    views = head[len("with "):head.rindex("\nselect 1")] + ","
    return _FOLD.format(views=views, share=_KELLY.format(f="0.25::double", c="0.10::double"), src="decided where should_bet")


@query("bankroll_fold", None)
def bankroll_fold(t):
    bets = decided(t).filter("should_bet")
    out = l.ledger_fold(bets, ["season"], ["game_date", "game_pk"], odds.kelly_fraction(c("model_prob"), c("odds")), c("odds"), c("won"))
    return out.select("game_pk", cents("stake").alias("stake_cents"), cents("pnl").alias("pnl_cents"), cents("bankroll").alias("bankroll_cents"))


from fungo import catalog as _catalog  # noqa: E402

_catalog.ORACLE["bankroll_fold"] = _fold_sql()

_FIXED = f"""
select x.*, {_PNL.format(s='stake')} as pnl from (
 select d.*, cast(round(cast({_KELLY.format(f='0.25::double', c='0.10::double')} * 100.0::double as decimal(24,6)), 2) as decimal(18,2)) as stake from decided d where should_bet) x"""


@query("bankroll_fixed_ref", """
select game_pk, cast(stake * 100 as bigint) as stake_cents, cast(pnl * 100 as bigint) as pnl_cents,
 cast((100 + sum(pnl) over (partition by season order by game_date, game_pk rows unbounded preceding)) * 100 as bigint) as bankroll_cents from fixed""",
       {"cand": CAND, "rules": RULES_SQL, "decided": DECIDED, "fixed": _FIXED})
def bankroll_fixed_ref(t):
    bets = decided(t).filter("should_bet")
    out = l.ledger_fixed(bets, ["season"], ["game_date", "game_pk"], odds.kelly_fraction(c("model_prob"), c("odds")), c("odds"), c("won"))
    return out.select("game_pk", cents("stake").alias("stake_cents"), cents("pnl").alias("pnl_cents"), cents("bankroll").alias("bankroll_cents"))


@query("bankroll_closed_form", f"""
select game_pk, cast(floor(100 * exp(sum(ln(1 + f * case when won then net else -1 end)) over (partition by season order by game_date, game_pk rows unbounded preceding)) * 100 + 0.5) as bigint) as bankroll_cents
from (select *, {_KELLY.format(f='0.25::double', c='0.10::double')} as f from decided where should_bet) x""", {"cand": CAND, "rules": RULES_SQL, "decided": DECIDED})
def bankroll_closed_form(t):
    bets = decided(t).filter("should_bet")
    out = l.ledger_closed_form(bets, ["season"], ["game_date", "game_pk"], odds.kelly_fraction(c("model_prob"), c("odds")), c("odds"), c("won"))
    return out.select("game_pk", F.floor(c("bankroll") * 100 + 0.5).cast("bigint").alias("bankroll_cents"))


@query("recalculate_ledger", f"""
select game_pk, cast(pnl * 100 as bigint) as pnl_cents,
 cast((500 + sum(pnl) over (partition by home_team order by game_date, game_pk rows unbounded preceding)) * 100 as bigint) as bankroll_cents
from (select *, case when game_pk % 20 = 0 then 0 else {_PNL.format(s='s')} end as pnl from (select *, cast((100 + game_pk % 4900) / 100.0 as decimal(18,2)) as s from cand) y) x""", {"cand": CAND})
def recalculate_ledger(t):
    book = candidates(t).withColumns({"stake": ((100 + c("game_pk") % 4900) / 100).cast("decimal(18,2)"), "won": F.when(c("game_pk") % 20 != 0, c("won"))})
    out = l.recalculate_ledger(book, ["home_team"], ["game_date", "game_pk"], 500.0)
    return out.select("game_pk", cents("pnl").alias("pnl_cents"), cents("bankroll").alias("bankroll_cents"))


_TUNE = """
select s.test_season, b.odds_bucket, case when s.total = 0 and b.odds_bucket = '+130:+170' then 0.06::double else x.thr end as edge_threshold,
 cast(coalesce(x.n, v.n, 0) as bigint) as prior_bets, x.roi as prior_flat_roi, x.good as profitable_years, s.total as total_years, x.score,
 case when x.thr is not null then 'selected' when s.total = 0 and b.odds_bucket = '+130:+170' then 'bootstrap: no prior seasons'
  when s.total = 0 then 'no prior seasons' else 'no profitable threshold found' end as reason
from (select a.season as test_season, count(b.season) as total from (select distinct season from cand) a left join (select distinct season from cand) b on b.season < a.season group by 1) s
cross join (select unnest(['<-180', '-180:-140', '-140:-115', '-115:+100', '+100:+130', '+130:+170', '+170+']) as odds_bucket) b
left join (select * from (select g.*, row_number() over (partition by test_season, odds_bucket order by score desc, thr) as rn from (
  select q.*, q.roi * least(1.0::double, q.n / 300::double) as score from (
   select test_season, odds_bucket, thr, total, cast(sum(n) as bigint) as n, cast(sum(pnl) as double) / cast(sum(n) as bigint) as roi, count(*) filter (pnl > 0) as good from (
    select s.test_season, s.total, k.odds_bucket, t.thr, k.season, count(*) as n, sum(cast(case when won then net else -1 end as decimal(18,8))) as pnl
    from (select a.season as test_season, count(b.season) as total from (select distinct season from cand) a left join (select distinct season from cand) b on b.season < a.season group by 1) s
    join cand k on k.season < s.test_season join (select unnest([0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10]::double[]) as thr) t on k.edge > t.thr
    group by 1, 2, 3, 4, 5) y group by 1, 2, 3, 4) q where n >= 30 and roi > 0 and good >= greatest(1, total - 1)) g) r where rn = 1) x
 on x.test_season = s.test_season and x.odds_bucket = b.odds_bucket
left join (select s.season as test_season, k.odds_bucket, count(*) as n from (select distinct season from cand) s join cand k on k.season < s.season group by 1, 2) v
 on v.test_season = s.test_season and v.odds_bucket = b.odds_bucket"""


@query("tune_thresholds", _TUNE, {"cand": CAND})
def tune_thresholds(t):
    return d.tune_thresholds(candidates(t))


_SEASONAL = {"cand": CAND, "tuned": _TUNE, "picked": "select test_season, odds_bucket, edge_threshold from tuned where reason = 'selected'",
             "seasonal": "select * from picked union all select distinct test_season, '+130:+170', 0.06::double from tuned where test_season not in (select test_season from picked)",
             "walked": "select k.*, r.edge_threshold as min_edge, coalesce(k.edge > r.edge_threshold, false) as should_bet from cand k left join seasonal r on r.test_season = k.season and r.odds_bucket = k.odds_bucket"}


@query("walk_forward_rules", """
select game_pk, season, odds_bucket, min_edge, should_bet, case when min_edge is null then odds_bucket || ' excluded by walk-forward'
 when should_bet then 'walk-forward: ' || odds_bucket || ' edge > ' || cast(floor(min_edge * 100 + 0.5) as bigint) || '%' else 'edge <= ' || cast(floor(min_edge * 100 + 0.5) as bigint) || '% threshold' end as policy_reason
from walked""", _SEASONAL)
def walk_forward_rules(t):
    """Rules tuned on earlier seasons, each applied to the season it is valid for."""
    return d.walk_forward_rules(candidates(t)).select("game_pk", "season", "odds_bucket", "min_edge", "should_bet", "policy_reason")


@query("walk_forward_summary", """
select season, count(*) as candidates, count(*) filter (should_bet) as bets, count(*) filter (should_bet and won) as wins,
 cast(sum(cast(case when should_bet then edge end as decimal(18,8))) as double) / nullif(count(*) filter (should_bet), 0) as avg_edge,
 cast(sum(cast(case when should_bet then case when won then net else -1 end end as decimal(18,8))) as double) / nullif(count(*) filter (should_bet), 0) as flat_roi from walked group by season""", _SEASONAL)
def walk_forward_summary(t):
    return d.season_summary(d.walk_forward_rules(candidates(t)))


@query("threshold_simulation", """
select t.thr as min_edge, count(k.game_pk) as bets, cast(count(*) filter (won) as double) / nullif(count(k.game_pk), 0) as win_rate,
 cast(sum(cast(edge as decimal(18,8))) as double) / nullif(count(k.game_pk), 0) as avg_raw_edge, cast(sum(cast(edge as decimal(18,8))) as double) / nullif(count(k.game_pk), 0) as avg_calibrated_edge,
 cast(sum(cast(case when won then net else -1 end as decimal(18,8))) as double) / nullif(count(k.game_pk), 0) as flat_stake_roi
from (select unnest([0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10]::double[]) as thr) t left join cand k on k.edge >= t.thr group by 1""", {"cand": CAND})
def threshold_simulation(t):
    return d.threshold_simulation(candidates(t))


_IMP = "case when {0} > 0 then 100 / ({0} + 100) else abs({0}) / (abs({0}) + 100) end"


@query("closing_line_value", f"""
select game_pk, case when side = 'home' then hp else 1 - hp end as close_prob, case when side = 'home' then hp else 1 - hp end - market_prob as clv_prob
from (select *, case when game_pk % 4 = 0 then p_market + 0.01::double when game_pk % 4 = 1 then null else ih / (ih + ia) end as hp
 from (select *, {_IMP.format('(case when game_pk % 4 <> 1 then home_ml - 1 end)')} as ih, {_IMP.format('away_ml')} as ia from cand) y) x""", {"cand": CAND})
def closing_line_value(t):
    g = c("game_pk") % 4
    df = candidates(t).withColumns({"close_consensus_prob": F.when(g == 0, c("p_market") + 0.01),
                                    "closing_home_ml": F.when(g != 1, c("home_ml") - 1), "close_away_ml": c("away_ml")})
    out = d.closing_line_value(df, ["close_consensus_prob", "closing_consensus_prob"], ["close_home_ml", "closing_home_ml"], ["close_away_ml"])
    return out.select("game_pk", "close_prob", "clv_prob")


_START = """select game_pk, max(case when team_side = 1 then pid end) as hs, max(case when team_side = 0 then pid end) as vs from (
 select game_pk, team_side, min(pitcher_id) as pid from appearances_v where is_starter = 1 group by 1, 2) s group by game_pk"""


def starters(t):
    pid = lambda s: F.min(F.when((c("team_side") == s) & (c("is_starter") == 1), c("pitcher_id")))
    s = t.appearances_v.groupBy("game_pk").agg(pid(1).alias("h"), pid(0).alias("a"))
    name = lambda x: F.when(c(x).isNotNull(), F.concat(F.lit("P"), c(x).cast("string")))
    hand = lambda x: F.when(c(x) % 3 == 0, "L").when(c(x).isNotNull(), "R")
    return s.select("game_pk", name("h").alias("home_sp_name"), name("a").alias("away_sp_name"), hand("h").alias("home_sp_throws"), hand("a").alias("away_sp_throws"))


@query("bet_context", """
select k.game_pk, side, odds < 0 as is_favorite, 'P' || case when side = 'home' then hs else vs end as sp_name, 'P' || case when side = 'home' then vs else hs end as opp_sp_name,
 case when (case when side = 'home' then hs else vs end) % 3 = 0 then 'L' when (case when side = 'home' then hs else vs end) is not null then 'R' end as sp_throws,
 case when (case when side = 'home' then vs else hs end) % 3 = 0 then 'L' when (case when side = 'home' then vs else hs end) is not null then 'R' end as opp_sp_throws
from cand k left join st on st.game_pk = k.game_pk""", {"cand": CAND, "st": _START})
def bet_context(t):
    return d.bet_context(candidates(t), starters(t), ["game_pk"]).select(
        "game_pk", "side", "is_favorite", "sp_name", "opp_sp_name", "sp_throws", "opp_sp_throws")


_SLATE = f"""
select game_pk, quota, selected, cast(stake * 100 as bigint) as stake_cents,
 cast(case when selected then stake + round(stake * cast(net as decimal(18,6)), 2) else 0 end * 100 as bigint) as to_win_cents,
 case when not selected and edge > 0.02 then 'outside top ' || quota || ' slate-ranked picks' end as slate_reason
from (select z.*, case when selected then cast(round(cast({_KELLY.format(f='0.25::double', c='0.10::double')} * 250.0::double as decimal(24,6)), 2) as decimal(18,2)) else 0 end as stake
 from (select y.*, coalesce(edge > 0.02 and rk <= quota, false) as selected from (
  select k.*, cast(greatest(1, least(3, ceil(count(*) over (partition by game_date) * 0.2::double))) as int) as quota,
   row_number() over (partition by game_date, edge > 0.02 order by model_prob * (1 + net) - 1 desc, game_pk) as rk from cand k) y) z) q"""


def _slate(t):
    df = candidates(t).withColumns({"has_edge": c("edge") > 0.02, "expected_roi": c("model_prob") * (1 + odds.net_odds(c("odds"))) - 1,
                                    "quality_prob": F.lit(None).cast("double")})
    return d.slate_ranking(df, ["game_date"], "game_pk", 250.0)


@query("slate_ranking", _SLATE, {"cand": CAND})
def slate_ranking(t):
    return _slate(t).select("game_pk", "quota", "selected", cents("stake").alias("stake_cents"), cents("to_win").alias("to_win_cents"), "slate_reason")


@query("grade_predictions", """
select game_pk, case when done then home_runs end as home_score, case when done then away_runs end as away_score, case when done then home_win end as home_win,
 case when done then (p_model > 0.5) = (home_win = 1) end as model_correct
from (select g.*, o.p_model, game_number = 1 and (g.game_pk % 5 = 0 or g.game_pk % 3 <> 0) as done from games_v g join odds_v o on o.game_pk = g.game_pk) x""")
def grade_predictions(t):
    g = t.games_v.join(t.odds_v.select("game_pk", "p_model"), "game_pk")
    known = (c("game_pk") % 5 == 0) & (c("game_number") == 1)
    log = g.select("game_pk", "game_date", "home_team", "away_team", "game_number", "p_model",
                   F.when(known, c("home_runs")).alias("home_score"), F.when(known, c("away_runs")).alias("away_score"),
                   F.when(known, c("home_win")).alias("home_win"), F.when(known, (c("p_model") > 0.5) == (c("home_win") == 1)).alias("model_correct"))
    finals = t.games_v.filter("game_pk % 3 <> 0 and game_number = 1").select(
        "game_date", "home_team", "away_team", "game_number", c("home_runs").alias("home_score"), c("away_runs").alias("away_score"))
    out = d.grade_predictions(log, finals, ["game_date", "home_team", "away_team", "game_number"])
    return out.select("game_pk", "home_score", "away_score", "home_win", "model_correct")


_STRATEGIES = [("value", 0.03, 0.25, 0.10, -130.0, None), ("tight", 0.06, 0.25, 0.05, None, None), ("dogs", 0.02, 0.5, 0.05, 130.0, 170.0), ("small", 0.0, 0.1, 0.02, None, 100.0)]


def _sweep_sql():
    from fungo.views import oracle
    rows = ", ".join("(" + ", ".join("null" if x is None else (f"'{x}'" if isinstance(x, str) else f"{x}::double") for x in s) + ")" for s in _STRATEGIES)
    head = oracle("select 1 from cand", {"cand": CAND})
    views = head[len("with "):head.rindex("\nselect 1")]
    share = _KELLY.format(f="frac", c="cap")
    return f"""
with recursive {views}, grid as (select * from (values {rows}) v(strategy, min_edge, frac, cap, min_odds, max_odds)),
bets as (select strategy, season, row_number() over (partition by strategy, season order by game_date, game_pk) as pos, won,
  cast(floor({share} * 100000000 + 0.5) as hugeint) as s, cast(floor(net * 1000000 + 0.5) as hugeint) as n
 from cand, grid where edge > min_edge and (min_odds is null or odds >= min_odds) and (max_odds is null or odds <= max_odds)),
walk as (select strategy, season, 0::bigint as pos, false as won, 0::hugeint as stake, 0::hugeint as pnl, 10000::hugeint as bal from (select distinct strategy, season from bets) q
 union all
 select b.strategy, b.season, b.pos, b.won, k.st, case when b.won then (2 * k.st * b.n + 1000000) // 2000000 else -k.st end,
  w.bal + case when b.won then (2 * k.st * b.n + 1000000) // 2000000 else -k.st end
 from walk w join bets b on b.strategy = w.strategy and b.season = w.season and b.pos = w.pos + 1, lateral (select (2 * w.bal * b.s + 100000000) // 200000000 as st) k)
select strategy, season, count(*) as bets, count(*) filter (won) as wins, cast(sum(stake) as bigint) as staked_cents, cast(sum(pnl) as bigint) as pnl_cents,
 cast(max_by(bal, pos) as bigint) as final_cents from walk where pos > 0 group by strategy, season"""


@query("strategy_sweep")
def strategy_sweep(t):
    out = l.strategy_sweep(candidates(t), ["season"], ["game_date", "game_pk"], _STRATEGIES)
    return out.select("strategy", "season", "bets", "wins", cents("staked").alias("staked_cents"), cents("pnl").alias("pnl_cents"),
                      cents("final_bankroll").alias("final_cents"))


_catalog.ORACLE["strategy_sweep"] = _sweep_sql()
