"""Composite feature pipelines."""

from pyspark.sql import functions as F

from fungo.catalog import ORACLE, query
from fungo.catalog.ingest import _EV, _EV_OUTS, _EV_RUNS, event_lines
from fungo.functions import geo, teams
from fungo.functions.plays import outs_on_play
from fungo.operators import aggregates as a
from fungo.operators.ordered import first_n_array
from fungo.operators.project import ZERO_ENDINGS
from fungo.plans import batting, defaults, environment as env, form, market, matrix, pitching, plays, scoring
from fungo.sources.readers import event_file_scan
from fungo.sources.shelf import Shelf
from fungo.views import VIEWS

c = F.col
PARKS = {"parks": teams.parks_sql()}

PF = """
select h.team, h.season, avg(h.rpg / w.rpg) over (partition by h.team order by h.season rows between 3 preceding and 1 preceding) as park_factor
from (select home_team as team, season, avg(home_runs + away_runs) as rpg from games_v group by 1, 2) h
join (select away_team as team, season, avg(home_runs + away_runs) as rpg from games_v group by 1, 2) w on w.team = h.team and w.season = h.season"""
ADJ = "case when {1} > 0 then {0} * (2.0::double / (1.0::double + {1})) else {0} end"


def pivot(cols, src, alias=None):
    """SQL that puts side rows of a game next to each other."""
    return "select game_pk, " + ", ".join(f"max(case when venue = '{s}' then {x} end) as {s}_{x}" for x in cols for s in ("home", "away")) + f" from {src} group by game_pk"


# --- play-by-play

def _states_sql(plays_sql, columns, most=4):
    """States by recursion over the plays of a half, one play of every half a step.

    ``plays_sql`` gives half, hn (1, 2, ... in the half), batter, ev, outs_made and ``columns``.
    """
    kind = "trim(regexp_extract(ev, '^([^./]*)', 1))"
    begins = lambda *hs: "(" + " or ".join(f"starts_with(kind, '{h}')" for h in hs) + ")"
    steps = (f"case when {begins('HR')} then 4 when {begins('T')} and not {begins('TP')} then 3 when {begins('D')} and not {begins('DI')} then 2 "
             f"when {begins('S')} and not {begins('SB')} then 1 when {begins('E', 'FC')} then 1 else 0 end")
    adv = ", ".join(f"regexp_extract(trim(coalesce(string_split(regexp_extract(ev, '^[^.]*\\.(.*)$', 1), ';')[{k}], '')), '^[B123][-X][123H]') as m{k}" for k in range(1, most + 1))
    parsed = f"select *, {steps} as steps, ({begins('W', 'IW', 'HP')} and not {begins('WP')}) as walk, {adv} from (select *, {kind} as kind from ({plays_sql}) p0) p1"
    people = lambda *xs: f"list_distinct(list_filter([{', '.join(xs)}], lambda x: x is not null))"
    case = lambda *vs: "case steps " + " ".join(f"when {4 - i} then {v}" for i, v in enumerate(vs[:4])) + f" else case when walk then {vs[4]} else {vs[5]} end end"
    none = "null::varchar"
    full = "s1 is not null and s2 is not null"
    step = f"""select *, {case(none, none, none, 'batter', 'batter', 's1')} as n1, {case(none, none, 'batter', 's1', 'case when s1 is not null then s1 else s2 end', 's2')} as n2,
 {case(none, 'batter', 's1', 's2', f'case when {full} then s2 else s3 end', 's3')} as n3,
 {case(people('batter', 's1', 's2', 's3'), people('s1', 's2', 's3'), people('s2', 's3'), people('s3'), f'case when {full} then ' + people('s3') + ' else []::varchar[] end', '[]::varchar[]')} as sc
 from (select st.b1 as s1, st.b2 as s2, st.b3 as s3, st.outs as ob, st.runs + st.scored as so_far, p.* from st join parsed p on p.half = st.half and p.hn = st.hn + 1) q0"""
    for k in range(1, most + 1):
        m = f"m{k}"
        who = f"case {m}[1] when 'B' then batter when '1' then s1 when '2' then s2 when '3' then s3 end"
        base = lambda i: f"case when who is null then n{i} when {m}[2] = '-' and {m}[3] = '{i}' then who when n{i} = who then null else n{i} end as n{i}"
        rest = "list_filter(sc, lambda x: x <> who)"
        step = (f"select * replace ({base(1)}, {base(2)}, {base(3)}, case when who is null then sc when {m}[2] = '-' and {m}[3] = 'H' then list_append({rest}, who) else {rest} end as sc) "
                f"from (select * {'' if k == 1 else 'exclude (who)'}, {who} as who from ({step}) x{k}) y{k}")
    out = "least(3, ob + outs_made)"
    left = [f"case when {out} < 3 then n{i} end as b{i}" for i in (1, 2, 3)]
    key = lambda o, bs: f"{o} || '_' || (" + " + ".join(f"case when {b} is not null then {2 ** i} else 0 end" for i, b in enumerate(bs)) + ")"
    final = f"select half, hn, {', '.join(left)}, {out} as outs, so_far as runs, len(sc) as scored, {key('ob', ['s1', 's2', 's3'])} as before, ob from ({step}) z"
    rec = f"""with recursive parsed as materialized ({parsed}),
st as (select distinct half, 0::bigint as hn, {none} as b1, {none} as b2, {none} as b3, 0 as outs, 0::bigint as runs, 0::bigint as scored, '' as before, 0 as ob from parsed union all {final})
select {columns}, before as state_before, {key('outs', ['b1', 'b2', 'b3'])} as state_after, ob::int as outs_before, outs::int as outs_after, scored::int as runs_scored, runs::int as runs_before
from st join parsed p on p.half = st.half and p.hn = st.hn"""
    return f"select * from ({rec}) final_states"


_EVENT_OUTS = f"{_EV_OUTS}[(l_partkey + l_suppkey) % 10 + 1]"
_EVENT_TEXT = "[" + ", ".join(f"'{x}'" for x in _EV) + "][(l_partkey + l_suppkey) % 10 + 1]"


@query("play_by_play_states", _states_sql(f"""
select *, game_id || '/' || half_seq as half, row_number() over (partition by game_id, half_seq order by line) as hn from (
 select *, cast(sum(chg) over (partition by game_id order by line rows unbounded preceding) - 1 as int) as half_seq from (
  select *, case when lag(inning || '/' || side) over (partition by game_id order by line) = inning || '/' || side then 0 else 1 end as chg from (
   select 'NYA1999' || lpad((l_orderkey % 12 + 1)::varchar, 2, '0') || lpad((l_orderkey % 28 + 1)::varchar, 2, '0') || l_orderkey as game_id, (l_linenumber::bigint * 2 + l_suppkey % 2) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 + 100 as line,
    l_linenumber as inning, l_suppkey % 2 as side, 'b' || l_partkey as batter, {_EVENT_TEXT} as ev, {_EVENT_OUTS} as outs_made from lineitem where l_orderkey in (select o_orderkey from orders)) a) b) c""", "game_id, half_seq, line"))
def play_by_play_states(t):
    out = plays.base_states(event_file_scan(event_lines(t)))
    return out.select("game_id", "half_seq", "line", "state_before", "state_after", "outs_before", "outs_after", "runs_scored", "runs_before")


@query("half_inning_states", _states_sql(f"""
select *, game || '/' || half_seq as half, row_number() over (partition by game, half_seq order by place, part, supp) as hn from (
 select l_orderkey // 40 as game, cast(l_orderkey % 40 // 5 as int) as half_seq, l_orderkey * 8 + l_linenumber as place, l_partkey as part, l_suppkey as supp, 'b' || l_partkey as batter, {_EVENT_TEXT} as ev, {_EVENT_OUTS} as outs_made from lineitem) a""",
    "game, half_seq, place, part, supp"))
def half_inning_states(t):
    """Half innings of some twenty plays: the lines of five orders."""
    ev = F.element_at(F.array(*[F.lit(x) for x in _EV]), ((c("l_partkey") + c("l_suppkey")) % len(_EV)).cast("int") + 1)
    rows = t.lineitem.select(F.floor(c("l_orderkey") / 40).cast("bigint").alias("game"), F.floor(c("l_orderkey") % 40 / 5).cast("int").alias("half_seq"),
                             (c("l_orderkey") * 8 + c("l_linenumber")).alias("place"), c("l_partkey").alias("part"), c("l_suppkey").alias("supp"),
                             F.concat(F.lit("b"), c("l_partkey").cast("string")).alias("batter_id"), ev.alias("event"))
    out = plays.half_inning_states(rows.withColumn("outs_made", outs_on_play(c("event"))), ["game", "half_seq"], ["place", "part", "supp"])
    return out.drop("batter_id", "event", "outs_made")


@query("event_pitcher_logs", f"""
select o_orderkey as block, s.side as team_side, case when s.side = 0 then 'a' || o_orderkey % 50 else 'h' || o_orderkey % 60 end as pitcher_id,
 cast(coalesce(x.outs, 0) as bigint) as outs_recorded, cast(coalesce(x.runs, 0) as bigint) as runs_allowed, 'u' || o_orderkey % 97 as ump_name, 'NYY' as home_team, 'CHC' as away_team
from orders, (values (0), (1)) s(side) left join (
 select l_orderkey, cast(1 - l_suppkey % 2 as int) as side, sum({_EV_OUTS}[(l_partkey + l_suppkey) % 10 + 1]) as outs, sum({_EV_RUNS}[(l_partkey + l_suppkey) % 10 + 1]) as runs from lineitem group by 1, 2) x
 on x.l_orderkey = o_orderkey and x.side = s.side""")
def event_pitcher_logs(t):
    logs = plays.pitcher_logs(event_file_scan(event_lines(t)))
    return logs.select(F.substring("game_id", 12, 20).cast("bigint").alias("block"), "team_side", "pitcher_id", "outs_recorded", "runs_allowed", "ump_name", "home_team", "away_team")


_VALUES = """
select v.*, runs_scored + case when outs_after >= 3 then 0.0::double else coalesce(b.re, 0) end - coalesce(a.re, 0) as offense_re24, coalesce(a.re, 0) as re_before, case when outs_after >= 3 then 0.0::double else coalesce(b.re, 0) end as re_after
from (select * from full_plays) v left join (select state_before, avg(to_end) as re from full_plays group by 1) a on a.state_before = v.state_before
left join (select state_before, avg(to_end) as re from full_plays group by 1) b on b.state_before = v.state_after"""
_FULL = """
select *, sum(runs_scored) over (partition by game_pk, batting_side) - coalesce(sum(runs_scored) over (partition by game_pk, batting_side order by play, batter, pitcher_id rows between unbounded preceding and 1 preceding), 0) as to_end from impact_plays_v"""
_PCTX = {"full_plays": _FULL, "vals": _VALUES}


def _values(t, season=None, plays_v=None, shelf=None):
    df = t.impact_plays_v if plays_v is None else plays_v
    return plays.play_values(df, ["game_pk", "batting_side"], ["play", "batter", "pitcher_id"], season, shelf=shelf)


@query("run_expectancy_deltas", "select game_pk, play, batter, pitcher_id, re_before, re_after, offense_re24, -offense_re24 as pitching_re24 from vals", _PCTX)
def run_expectancy_deltas(t):
    return _values(t).select("game_pk", "play", "batter", "pitcher_id", "re_before", "re_after", "offense_re24", "pitching_re24")


@query("run_expectancy_as_of", """
select v.game_pk, v.play, v.batter, v.pitcher_id, coalesce(p.re, 0.0::double) as re_before from full_plays v left join (
 select s.season, f.state_before, cast(sum(f.to_end) as double) / count(*) as re from (select distinct season from full_plays) s join full_plays f on f.season < s.season group by 1, 2) p
 on p.season = v.season and p.state_before = v.state_before""", {"full_plays": _FULL})
def run_expectancy_as_of(t):
    return _values(t, "season").select("game_pk", "play", "batter", "pitcher_id", "re_before")


_DSUM = "sum(cast({} as decimal(18,8)))"
_IMPACT = f"""
with off as (select game_pk, team, case when count(*) over w >= 5 then cast(sum(v) over w as double) / count(*) over w end as x from (select game_date, game_pk, batting_team as team, {_DSUM.format('offense_re24')} as v from vals group by 1, 2, 3) q
  window w as (partition by team order by game_date, game_pk rows between 15 preceding and 1 preceding)),
sp as (select game_pk, pitcher_id, case when count(*) over w >= 2 then cast(sum(v) over w as double) / count(*) over w end as x from (select game_date, game_pk, pitcher_id, {_DSUM.format('-offense_re24')} as v from vals where is_starter = 1 group by 1, 2, 3) q
  window w as (partition by pitcher_id order by game_date, game_pk rows between 3 preceding and 1 preceding)),
bp as (select team, game_date, cast(sum(v) over w as double) / nullif(count(v) over w, 0) as x from (select pitching_team as team, game_date, {_DSUM.format('-offense_re24')} as v from vals where is_starter = 0 group by 1, 2) q
  window w as (partition by team order by game_date range between interval 15 days preceding and interval 1 day preceding))
select g.game_pk, o1.x as home_offense_re24_15g, o2.x as away_offense_re24_15g, s1.x as home_sp_re24_last3, s2.x as away_sp_re24_last3, b1.x as home_bullpen_re24_15d, b2.x as away_bullpen_re24_15d,
 o1.x - o2.x as offense_re24_diff, s1.x - s2.x as sp_re24_diff, b1.x - b2.x as bullpen_re24_diff
from staffed_games_v g left join off o1 on o1.game_pk = g.game_pk and o1.team = g.home_team left join off o2 on o2.game_pk = g.game_pk and o2.team = g.away_team
left join sp s1 on s1.game_pk = g.game_pk and s1.pitcher_id = g.home_sp_id left join sp s2 on s2.game_pk = g.game_pk and s2.pitcher_id = g.away_sp_id
left join bp b1 on b1.team = g.home_team and b1.game_date = g.game_date left join bp b2 on b2.team = g.away_team and b2.game_date = g.game_date"""


@query("impact_form", "select * from (" + _IMPACT + ") z", _PCTX)
def impact_form(t):
    shelf = Shelf(t.spark)
    fine = shelf.put("values", plays.summed_values(_values(t, shelf=shelf)), ["game_pk"], dealt=True)
    return plays.impact_form(t.staffed_games_v, fine)


def _variant_sql(name, lengths):
    n, m, d = lengths
    text = _IMPACT.replace("between 15 preceding", f"between {n} preceding").replace(">= 5 then", f">= {max(3, n // 3)} then").replace("between 3 preceding", f"between {m} preceding")
    text = text.replace(">= 2 then", f">= {max(2, m // 2)} then").replace("interval 15 days", f"interval {d} days")
    return f"select '{name}' as variant, * from ({text}) v_{name}"


@query("impact_variants", " union all ".join(_variant_sql(n, v) for n, v in plays.VARIANTS.items()), _PCTX)
def impact_variants(t):
    shelf = Shelf(t.spark)
    fine = shelf.put("values", plays.summed_values(_values(t, shelf=shelf)), ["game_pk"], dealt=True)
    return plays.impact_variants(t.staffed_games_v, fine)


# --- team form

_FORM_ROWS = """
select game_pk, game_date, season, team, opponent, venue, case when count(run_diff) over w15 >= 5 then avg(run_diff) over w15 end as rolling_rd, case when count(rf) over w15 >= 5 then avg(rf) over w15 end as rolling_rs,
 case when count(run_diff) over w7 >= 3 then avg(run_diff) over w7 end as last7_rd, case when count(*) over wv >= 3 then avg(run_diff) over wv end as venue_rd,
 case when count(*) over ws >= 10 then avg(case when run_diff > 0 then 1 else 0 end) over ws end as season_win_pct,
 cast(coalesce(lag(case when s > 0 then n else -n end) over (partition by team order by game_date, game_pk), 0) as bigint) as streak
from (select *, row_number() over (partition by team, isl order by game_date, game_pk) as n from (
  select *, sum(chg) over (partition by team order by game_date, game_pk rows unbounded preceding) as isl from (
    select *, case when s = lag(s) over (partition by team order by game_date, game_pk) then 0 else 1 end as chg from (select *, case when run_diff > 0 then 1 else -1 end as s from team_games_v) a) b) c) d
window w15 as (partition by team order by game_date, game_pk rows between 15 preceding and 1 preceding), w7 as (partition by team order by game_date, game_pk rows between 7 preceding and 1 preceding),
 wv as (partition by team, venue order by game_date, game_pk rows between 15 preceding and 1 preceding), ws as (partition by team, season order by game_date, game_pk rows between unbounded preceding and 1 preceding)"""
_FORM_COLS = ["rolling_rd", "rolling_rs", "last7_rd", "momentum", "streak", "season_win_pct", "home_rd", "away_rd"]
_FORM = pivot(_FORM_COLS, "(select *, last7_rd - rolling_rd as momentum, case when venue = 'home' then venue_rd end as home_rd, case when venue = 'away' then venue_rd end as away_rd from form_rows) f")


@query("team_form", _FORM, {"form_rows": _FORM_ROWS})
def team_form(t):
    return form.team_form(t.games_v)


_H2H = """
select game_pk, case when n >= 3 then wr end as h2h_home_win_rate, case when n >= 3 then rd end as h2h_home_run_diff from (
 select game_pk, venue, count(*) over w as n, avg(case when run_diff > 0 then 1 else 0 end) over w as wr, avg(run_diff) over w as rd from team_games_v window w as (partition by team, opponent order by game_date, game_pk rows between 10 preceding and 1 preceding)) x where venue = 'home'"""


@query("head_to_head", _H2H)
def head_to_head(t):
    return form.head_to_head(t.games_v)


_PYTH = "select team, season + 1 as season, r * r / (r * r + q * q) as prior_win_pct from (select team, season, cast(sum(rf) as double) as r, cast(sum(ra) as double) as q from team_games_v group by 1, 2) x"
_PRIOR = "select g.game_pk, h.prior_win_pct as home_prior_win_pct, a.prior_win_pct as away_prior_win_pct from games_v g left join pyth h on h.team = g.home_team and h.season = g.season left join pyth a on a.team = g.away_team and a.season = g.season"


@query("prior_pythagorean", _PRIOR, {"pyth": _PYTH})
def prior_pythagorean(t):
    return form.prior_pythagorean(t.games_v)


_AFTER = _FORM_ROWS.replace("between 15 preceding and 1 preceding", "between 14 preceding and current row").replace("between 7 preceding and 1 preceding", "between 6 preceding and current row").replace(
    "unbounded preceding and 1 preceding", "unbounded preceding and current row").replace("cast(coalesce(lag(case when s > 0 then n else -n end) over (partition by team order by game_date, game_pk), 0) as bigint)", "cast(case when s > 0 then n else -n end as bigint)")


@query("team_form_board", """
with l as (select *, last7_rd - rolling_rd as momentum from after_rows qualify row_number() over (partition by team order by game_date desc, game_pk desc) = 1)
(select team, game_date, rolling_rd, last7_rd, streak, momentum, 'hot' as list from l order by momentum desc, team limit 5) union all (select team, game_date, rolling_rd, last7_rd, streak, momentum, 'cold' from l order by momentum, team limit 5)""".replace(
    "with l as (", "select * from (with l as (") + ") z", {"after_rows": _AFTER})
def team_form_board(t):
    return form.form_board(t.games_v)


# --- pitching

def _factors(t):
    return a.park_factor(t.games_v)


_ERA = f"""
with st as (select s.*, {ADJ.format('era', 'f.park_factor')} as era_adj from pitcher_stats_v s left join pf f on f.team = s.team and f.season = s.season where gs >= 1 and era is not null),
one as (select name_norm, season + 1 as season, era, era_adj from st qualify row_number() over (partition by name_norm, season order by gs desc, team desc) = 1),
tm as (select team, season + 1 as season, cast(sum(cast(era * gs as decimal(18,8))) as double) / cast(sum(cast(cast(gs as double) as decimal(18,8))) as double) as era,
  cast(sum(cast(era_adj * gs as decimal(18,8))) as double) / cast(sum(cast(cast(gs as double) as decimal(18,8))) as double) as era_adj from st group by 1, 2),
rows as (select g.game_pk, g.venue, coalesce(o.era, t.era) as sp_era, coalesce(o.era_adj, t.era_adj) as sp_era_adj, case when o.era is not null then 'pitcher' when t.era is not null then 'team' else 'none' end as sp_era_tier
 from (select game_pk, 'home' as venue, home_team as team, home_name_norm as nm, season from staffed_games_v union all select game_pk, 'away', away_team, away_name_norm, season from staffed_games_v) g
 left join one o on o.name_norm = g.nm and o.season = g.season left join tm t on t.team = g.team and t.season = g.season)
{pivot(['sp_era', 'sp_era_adj', 'sp_era_tier'], 'rows')}"""


@query("starter_era", f"select * from ({_ERA}) z", {"pf": PF})
def starter_era(t):
    return pitching.starter_era(t.staffed_games_v, t.pitcher_stats_v, _factors(t))


@query("park_factor_attach", "select g.game_pk, f.park_factor from games_v g left join pf f on f.team = g.home_team and f.season = g.season", {"pf": PF})
def park_factor_attach(t):
    return env.park_factor_attach(t.games_v).select("game_pk", "park_factor")


_STUFF_V = """
select name_norm, season, max(team) as team, cast(sum(pa) as bigint) as pa, cast(sum(pa) % 900 as double) / 10 as fbv, cast(sum(pa) % 31 as double) / 100 as swstr,
 case when sum(pa) % 7 <> 0 then cast(sum(gs) % 17 as double) / 50 end as k_pct, cast(sum(gs) % 9 as double) / 2 as xfip, case when max(team) % 3 = 0 then 'L' when max(team) % 3 = 1 then 'R' end as throws
from pitcher_stats_v group by name_norm, season"""


def _stuff(t):
    return t.sql(_STUFF_V)


def _stuff_value(x):
    blend = lambda p: f"case when cur.{x} is not null and {p} is not null then cur.{x} * w + {p} * (1 - w) else coalesce(cur.{x}, {p}) end"
    med = f"(select median(o.{x}) from stuff o where o.season = q.season and o.pa >= 40 and o.name_norm <> q.nm)"
    return f"case when cur_pa >= 150 then cur_{x} when cur_pa is not null and pri_pa is not null then case when cur_{x} is not null and pri_{x} is not null then cur_{x} * w + pri_{x} * (1 - w) else coalesce(cur_{x}, pri_{x}) end when cur_pa is not null then case when cur_{x} is not null and {med} is not null then cur_{x} * w + {med} * (1 - w) else coalesce(cur_{x}, {med}) end when pri_pa is not null then pri_{x} else tm_{x} end as sp_{x}"


_STUFF_SQL = f"""
with asks as (select distinct nm, team, season from (select home_name_norm as nm, home_team as team, season from staffed_games_v union all select away_name_norm, away_team, season from staffed_games_v) u),
tm as (select team, season, {', '.join(f'median({x}) as tm_{x}' for x in pitching.STUFF)} from stuff group by 1, 2),
q as (select a.*, cur.pa as cur_pa, pri.pa as pri_pa, greatest(0.0::double, least(1.0::double, cur.pa / 150.0::double)) as w, {', '.join(f'cur.{x} as cur_{x}, pri.{x} as pri_{x}, tm.tm_{x}' for x in pitching.STUFF)},
  coalesce(cur.throws, pri.throws) as throws
 from asks a left join stuff cur on cur.name_norm = a.nm and cur.season = a.season asof left join stuff pri on pri.name_norm = a.nm and pri.season < a.season left join tm on tm.team = a.team and tm.season = a.season),
val as (select nm, team, season, throws as sp_throws, coalesce(cur_pa, pri_pa) as sp_pa, {', '.join(_stuff_value(x) for x in pitching.STUFF)} from q),
rows as (select g.game_pk, g.venue, v.* from (select game_pk, 'home' as venue, home_team as team, home_name_norm as nm, season from staffed_games_v union all select game_pk, 'away', away_team, away_name_norm, season from staffed_games_v) g
 left join val v on v.nm = g.nm and v.team = g.team and v.season = g.season)
{pivot([f'sp_{x}' for x in pitching.STUFF] + ['sp_throws', 'sp_pa'], 'rows')}"""


@query("stuff_attach", f"select * from ({_STUFF_SQL}) z", {"stuff": _STUFF_V})
def stuff_attach(t):
    """Games and season values are written once: blends, medians and seasons before read them many times."""
    shelf = Shelf(t.spark)
    games = shelf.put("staffed", t.staffed_games_v, ["game_pk"])
    return pitching.stuff_attach(games, shelf.put("stuff", _stuff(t), ["name_norm", "season"]))


@query("rest_and_travel", f"""
with side as (select game_pk, 'home' as venue, home_team as team, game_date, home_team as loc from games_v union all select game_pk, 'away', away_team, game_date, home_team from games_v),
days as (select team, game_date, arg_min(loc, game_pk) as loc from side group by 1, 2),
mv as (select *, lag(game_date) over (partition by team order by game_date) as pd, lag(loc) over (partition by team order by game_date) as pl from days),
r as (select m.team, m.game_date, case when pd is not null then least(7, greatest(0, cast(m.game_date - pd as int) - 1)) end as days_rest,
 case when pl is null or pl = loc then 0 else cast(floor(2 * 3958.8 * asin(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))) * 1000 + 0.5) as bigint) end as travel_milli
 from mv m left join parks a on a.team = m.pl left join parks b on b.team = m.loc),
rows as (select s.game_pk, s.venue, r.days_rest, r.travel_milli from side s left join r on r.team = s.team and r.game_date = s.game_date)
{pivot(['days_rest', 'travel_milli'], 'rows')}""".replace("with side as", "select * from (with side as") + ") z", PARKS)
def rest_and_travel(t):
    out = env.rest_and_travel(t.games_v, teams.parks(t.spark))
    milli = lambda s: F.floor(c(f"{s}_travel_miles") * 1000 + 0.5).cast("bigint").alias(f"{s}_travel_milli")
    return out.select("game_pk", "home_days_rest", "away_days_rest", milli("home"), milli("away"))


_STARTS = "select * from dated_appearances_v where is_starter = 1"


@query("starter_workload", """
select g.game_pk, h.r as home_sp_days_rest, a.r as away_sp_days_rest, h.o as home_sp_outs_last, a.o as away_sp_outs_last from staffed_games_v g left join wk h on h.game_pk = g.game_pk and h.pitcher_id = g.home_sp_id left join wk a on a.game_pk = g.game_pk and a.pitcher_id = g.away_sp_id""",
       {"starts": _STARTS, "wk": "select game_pk, pitcher_id, lag(outs_recorded) over w as o, case when lag(game_date) over w is not null then least(10, greatest(0, cast(game_date - lag(game_date) over w as int) - 1)) end as r from starts window w as (partition by pitcher_id order by game_date, game_pk)"})
def starter_workload(t):
    return pitching.starter_workload(t.staffed_games_v, t.dated_appearances_v)


def _ra(n):
    return f"case when count(*) over w{n} >= 2 and sum(outs_recorded) over w{n} >= 1 then cast(sum(runs_allowed) over w{n} as double) * 27 / sum(outs_recorded) over w{n} end"


@query("starter_inseason", """
select g.game_pk, h.e5 as home_sp_inseason_era, a.e5 as away_sp_inseason_era, h.e3 as home_sp_last3_era, a.e3 as away_sp_last3_era from staffed_games_v g left join era h on h.game_pk = g.game_pk and h.pitcher_id = g.home_sp_id left join era a on a.game_pk = g.game_pk and a.pitcher_id = g.away_sp_id""",
       {"starts": _STARTS, "pf": PF, "era": f"select r.game_pk, r.pitcher_id, {ADJ.format('e5', 'f.park_factor')} as e5, {ADJ.format('e3', 'f.park_factor')} as e3 from (select *, {_ra(5)} as e5, {_ra(3)} as e3 from starts window w5 as (partition by pitcher_id order by game_date, game_pk rows between 5 preceding and 1 preceding), w3 as (partition by pitcher_id order by game_date, game_pk rows between 3 preceding and 1 preceding)) r left join pf f on f.team = r.team and f.season = r.season"})
def starter_inseason(t):
    return pitching.starter_inseason(t.staffed_games_v, t.dated_appearances_v, _factors(t))


@query("bullpen_form", """
select g.game_pk, h.e as home_bullpen_inseason_era, a.e as away_bullpen_inseason_era, hu.o as home_bullpen_outs_3d, au.o as away_bullpen_outs_3d from games_v g
 left join bp h on h.team = g.home_team and h.game_date = g.game_date left join bp a on a.team = g.away_team and a.game_date = g.game_date
 left join use3 hu on hu.game_pk = g.game_pk and hu.team = g.home_team left join use3 au on au.game_pk = g.game_pk and au.team = g.away_team""",
       {"pf": PF, "rl": "select team, season, game_date, sum(runs_allowed) as r, sum(outs_recorded) as o from dated_appearances_v where is_starter = 0 group by 1, 2, 3",
        "bp": f"select x.team, x.game_date, {ADJ.format('x.e', 'f.park_factor')} as e from (select *, case when count(*) over w >= 5 and sum(o) over w >= 1 then cast(sum(r) over w as double) * 27 / sum(o) over w end as e from rl window w as (partition by team order by game_date rows between 15 preceding and 1 preceding)) x left join pf f on f.team = x.team and f.season = x.season",
        "use3": "select t.game_pk, t.team, cast(sum(r.o) as bigint) as o from team_games_v t left join rl r on r.team = t.team and r.game_date < t.game_date and r.game_date >= t.game_date - interval 3 days group by 1, 2"})
def bullpen_form(t):
    return pitching.bullpen(t.games_v, t.dated_appearances_v, _factors(t))


# --- batting

_NAMES = ["Chicago", "New York", "Los Angeles", "Houston", "Boston", "Chicago,Boston"]
_BAT = """
select pitcher_id, season, (pitcher_id % 6) as k, cast(sum(outs_recorded) as bigint) as pa, cast(sum(runs_allowed) as double) / 100 as ops from dated_appearances_v group by 1, 2"""


@query("batting_quality", """
select team, season, cast(sum(cast(ops * pa as decimal(18,8))) as double) / cast(sum(cast(cast(pa as double) as decimal(18,8))) as double) as team_ops
from (select case when k = 0 then case when pitcher_id // 6 % 2 = 0 then 'CHW' else 'CHC' end when k = 1 then case when pitcher_id // 6 % 2 = 0 then 'NYY' else 'NYM' end
 when k = 2 then case when pitcher_id // 6 % 2 = 0 then 'LAA' else 'LAD' end when k = 3 then 'HOU' else 'BOS' end as team, season, pa, ops from bat where k < 5 and pa >= 10 and pitcher_id % 11 <> 0) x group by 1, 2""", {"bat": _BAT})
def batting_quality(t):
    raw = t.sql(_BAT)
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), c("k").cast("int") + 1)
    lev = F.when(c("pitcher_id") % 11 == 0, "Min-AL").when(F.floor(c("pitcher_id") / 6) % 2 == 0, "Maj-AL").otherwise("Maj-NL")
    stats = raw.select(name.alias("Tm"), lev.alias("Lev"), "season", c("pa").cast("string").alias("PA"), c("ops").cast("string").alias("OPS"))
    return batting.team_quality(stats)


@query("contact_quality", """
select g.game_pk, h.b as home_barrel_pct, a.b as away_barrel_pct, h.x as home_hard_hit_pct, a.x as away_hard_hit_pct from games_v g
 left join cq h on h.team = g.home_team and h.season = g.season left join cq a on a.team = g.away_team and a.season = g.season""",
       {"cq": "select team, season + 1 as season, cast(sum(runs_allowed) as double) / nullif(sum(outs_recorded), 0) as b, cast(sum(is_starter) as double) / nullif(sum(outs_recorded), 0) as x from dated_appearances_v group by team, season"})
def contact_quality(t):
    rows = t.dated_appearances_v.select("team", "season", c("runs_allowed").alias("barrels"), c("outs_recorded").alias("bbe"), c("is_starter").alias("hard_hit"))
    return batting.prior_season_attach(t.games_v, batting.contact_quality(rows), ["barrel_pct", "hard_hit_pct"])


_SPLITS = """
select team, season, cast(sum(runs_allowed) as double) / 1000 as ops_vs_lhp, case when team % 4 <> 0 then cast(sum(outs_recorded) as double) / 9000 end as ops_vs_rhp, cast(sum(is_starter) as bigint) as pa_vs_lhp, count(*) as pa_vs_rhp from dated_appearances_v group by team, season"""
_HAND = "case when {0} % 3 = 0 then 'L' when {0} % 3 = 1 then 'R' end"


def _handed(t):
    hand = lambda s: F.when(c(f"{s}_sp_id") % 3 == 0, "L").when(c(f"{s}_sp_id") % 3 == 1, "R")
    ops = lambda s: (c(f"{s}_team") % 10 + 65) / 100.0
    return t.staffed_games_v.withColumns({"home_sp_throws": hand("home"), "away_sp_throws": hand("away"), "home_team_ops": ops("home"), "away_team_ops": ops("away")})


@query("handedness_splits", f"""
with side as (select game_pk, season, 'home' as venue, home_team as team, {_HAND.format('home_sp_id')} as own, {_HAND.format('away_sp_id')} as opp from staffed_games_v union all select game_pk, season, 'away', away_team, {_HAND.format('away_sp_id')}, {_HAND.format('home_sp_id')} from staffed_games_v),
rows as (select game_pk, venue, v as batting_ops_vs_sp, v - (team % 10 + 65) / 100.0::double as platoon_advantage, case when opp in ('L', 'R') then case when opp = 'L' then 1.0 else 0.0 end end::double as opp_sp_is_lhp,
 case when own in ('L', 'R') then case when own = 'L' then 1.0 else 0.0 end end::double as sp_is_lhp, case when own is not null and opp is not null then case when own = opp then 1.0 else 0.0 end end::double as same
 from (select s.*, case when opp = 'L' then p.ops_vs_lhp when opp = 'R' then p.ops_vs_rhp else case when p.ops_vs_lhp is not null and p.ops_vs_rhp is not null then (p.ops_vs_lhp * p.pa_vs_lhp + p.ops_vs_rhp * p.pa_vs_rhp) / (p.pa_vs_lhp + p.pa_vs_rhp) else coalesce(p.ops_vs_lhp, p.ops_vs_rhp) end end as v
  from side s left join sp p on p.team = s.team and p.season + 1 = s.season) q)
select game_pk, home_batting_ops_vs_sp, away_batting_ops_vs_sp, home_platoon_advantage, away_platoon_advantage, home_opp_sp_is_lhp, away_opp_sp_is_lhp, home_sp_is_lhp, away_sp_is_lhp, home_same as both_sp_same_hand from ({pivot(['batting_ops_vs_sp', 'platoon_advantage', 'opp_sp_is_lhp', 'sp_is_lhp', 'same'], 'rows')}) y""".replace("with side as", "select * from (with side as") + ") z", {"sp": _SPLITS})
def handedness_splits(t):
    return batting.handedness_splits(_handed(t), t.sql(_SPLITS))


_BATTERS = """
select l_partkey as player, cast(year(l_shipdate) as int) as season, cast(sum(cast(l_quantity as bigint)) as double) / 100 as ops_vs_lhp, case when l_partkey % 5 <> 0 then cast(count(*) as double) / 10 end as ops_vs_rhp,
 cast(count(*) * 40 as bigint) as pa_vs_lhp, cast(sum(cast(l_quantity as bigint)) as bigint) as pa_vs_rhp from lineitem group by l_partkey, year(l_shipdate)"""


def _lineup_mean(h):
    a = f"case when p.ops_vs_{h} is not null and p.pa_vs_{h} > 0 then least(cast(p.pa_vs_{h} as double), 200.0::double) else 0.0::double end"
    b = f"case when c.ops_vs_{h} is not null and c.pa_vs_{h} > 0 then cast(c.pa_vs_{h} as double) else 0.0::double end"
    v = f"(case when {a} + {b} > 0 then (coalesce(p.ops_vs_{h}, 0) * {a} + coalesce(c.ops_vs_{h}, 0) * {b}) / ({a} + {b}) end)"
    w = f"cast(greatest(1, coalesce(p.pa_vs_{h}, 0) + coalesce(c.pa_vs_{h}, 0)) as double)"
    return f"cast(sum(cast({v} * {w} as decimal(18,8))) as double) / cast(sum(cast(case when {v} is not null then {w} end as decimal(18,8))) as double) as {h}, count({v}) as k_{h}"


@query("lineup_splits", f"""
with side as (select game_pk, season, 'home' as venue, {_HAND.format('away_sp_id')} as opp from staffed_games_v union all select game_pk, season, 'away', {_HAND.format('home_sp_id')} from staffed_games_v),
ln as (select l_orderkey as game_pk, case when l_suppkey % 2 = 1 then 'home' else 'away' end as venue, l_partkey as player, row_number() over (partition by l_orderkey, l_suppkey % 2 order by l_linenumber, l_partkey, l_suppkey) as slot from lineitem),
m as (select s.game_pk, s.venue, {_lineup_mean('lhp')}, {_lineup_mean('rhp')} from side s join ln l on l.game_pk = s.game_pk and l.venue = s.venue and slot <= 9
 left join bt c on c.player = l.player and c.season = s.season left join bt p on p.player = l.player and p.season + 1 = s.season group by 1, 2),
rows as (select s.game_pk, s.venue, m.lhp as lineup_ops_vs_lhp, m.rhp as lineup_ops_vs_rhp, case when opp = 'L' then m.lhp when opp = 'R' then m.rhp end as lineup_ops_vs_sp, greatest(m.k_lhp, m.k_rhp) as lineup_known_batters from side s left join m on m.game_pk = s.game_pk and m.venue = s.venue)
select *, home_lineup_ops_vs_sp - away_lineup_ops_vs_sp as lineup_ops_vs_sp_diff from ({pivot(['lineup_ops_vs_lhp', 'lineup_ops_vs_rhp', 'lineup_ops_vs_sp', 'lineup_known_batters'], 'rows')}) y""".replace("with side as", "select * from (with side as") + ") z", {"bt": _BATTERS})
def lineup_splits(t):
    return batting.lineup_splits(_handed(t), _lineups(t), t.sql(_BATTERS))


def _lineups(t, dealt=()):
    """Up to nine batters per game and side. ``dealt`` names keys to deal the lines by instead of both."""
    batters = t.lineitem.select(c("l_orderkey").alias("game_pk"), F.when(c("l_suppkey") % 2 == 1, "home").otherwise("away").alias("venue"), "l_linenumber", "l_partkey", "l_suppkey")
    batters = batters.repartition(*dealt) if dealt else batters
    return first_n_array(batters, ["game_pk", "venue"], ["l_linenumber", "l_partkey", "l_suppkey"], 9, "l_partkey", "ids")


# --- environment and market

_WX = "select game_date, home_team, cast(max(game_pk % 60) + 40 as double) as temp_f, cast(max(game_pk % 25) as double) as wind_speed_mph, cast(max((game_pk * 37) % 360) as double) as wind_dir_deg, cast(max(game_pk % 50) as double) as humidity_pct from games_v where game_pk % 4 <> 0 group by 1, 2"


@query("weather_attach", f"""
select game_pk, temp_f, wind_speed_mph, humidity_pct, cast(floor(case when dome then 0 else coalesce(wind_speed_mph, 0) * cos(radians((coalesce(wind_dir_deg, 0) + 180) % 360 - b)) end * 1000 + 0.5) as bigint) as wind_milli
from (select g.game_pk, g.home_team = {teams.CODES.index('TBR')} as dome, case when g.home_team = {teams.CODES.index('TBR')} then 72.0 else w.temp_f end::double as temp_f, case when g.home_team = {teams.CODES.index('TBR')} then 0.0 else w.wind_speed_mph end::double as wind_speed_mph,
 w.wind_dir_deg, case when g.home_team = {teams.CODES.index('TBR')} then 50.0 else w.humidity_pct end::double as humidity_pct, {[geo.CENTRE_BEARING[k] for k in teams.CODES]}[g.home_team + 1] as b from games_v g left join wx w on w.game_date = g.game_date and w.home_team = g.home_team) x""", {"wx": _WX})
def weather_attach(t):
    out = env.weather(t.games_v, t.sql(_WX), teams.parks(t.spark))
    return out.select("game_pk", "temp_f", "wind_speed_mph", "humidity_pct", F.floor(c("wind_to_cf") * 1000 + 0.5).cast("bigint").alias("wind_milli"))


@query("umpire_factor_as_of", """
select game_pk, coalesce(case when n >= 20 then m / lg end, 1.0) as ump_run_factor
from (select u.*, avg(runs) over (partition by ump order by game_date, game_pk rows between unbounded preceding and 1 preceding) as m, count(*) over (partition by ump order by game_date, game_pk rows between unbounded preceding and 1 preceding) as n, l.lg
 from (select game_pk, game_date, season, game_pk % 97 as ump, home_runs + away_runs as runs from games_v) u left join (select season + 1 as season, avg(home_runs + away_runs) as lg from games_v group by 1) l on u.season = l.season) x""")
def umpire_factor_as_of(t):
    return env.umpire_factor(t.games_v.withColumn("ump", c("game_pk") % 97), league_as_of=True).select("game_pk", "ump_run_factor")


@query("injured_lists", """
select g.game_pk, coalesce(h.il_count, 0) as home_il_count, coalesce(a.il_count, 0) as away_il_count, coalesce(h.il_count, 0) - coalesce(a.il_count, 0) as il_diff, h.il_count % 13 as home_il_war, a.il_count % 13 as away_il_war
from games_v g asof left join snapshots_v h on h.team = g.home_team and h.snap_date <= g.game_date asof left join snapshots_v a on a.team = g.away_team and a.snap_date <= g.game_date""")
def injured_lists(t):
    values = t.snapshots_v.select("team", "snap_date", (c("il_count") % 13).alias("il_war"))
    return env.injured_lists(t.games_v, t.snapshots_v, values)


_IMP = "case when {0} > 0 then 100 / ({0} + 100) else abs({0}) / (abs({0}) + 100) end"


@query("market_attach", f"""
select game_pk, case when game_pk % 6 <> 0 then h / (h + a) end as vegas_home_prob from (select game_pk, {_IMP.format('home_ml')} as h, {_IMP.format('away_ml')} as a from odds_v) x""")
def market_attach(t):
    q = t.market_v.filter("game_pk % 6 <> 0").select("game_date", "home_team", "away_team", "game_number", "home_ml", "away_ml")
    stored = q.withColumns({"fetched_at": F.lit(2)}).unionByName(q.withColumns({"fetched_at": F.lit(1), "home_ml": c("home_ml") + 7})).unionByName(
        q.withColumns({"fetched_at": F.lit(3), "home_ml": F.lit(12.0)}))
    return market.market_attach(t.games_v, stored)


_MATRIX = """
with w as (select g.*, f.* exclude (game_pk), h.* exclude (game_pk), p.* exclude (game_pk) from games_v g left join form f on f.game_pk = g.game_pk left join h2h h on h.game_pk = g.game_pk left join prior p on p.game_pk = g.game_pk)
select game_pk, home_rolling_rd, away_rolling_rd, home_rolling_rs, away_rolling_rs, home_last7_rd, away_last7_rd, coalesce(home_momentum, 0.0::double) as home_momentum, coalesce(away_momentum, 0.0::double) as away_momentum, home_streak, away_streak,
 coalesce(home_season_win_pct, 0.5::double) as home_season_win_pct, coalesce(away_season_win_pct, 0.5::double) as away_season_win_pct, coalesce(home_home_rd, 0.0::double) as home_home_rd, coalesce(away_away_rd, 0.0::double) as away_away_rd,
 coalesce(h2h_home_win_rate, 0.5::double) as h2h_home_win_rate, coalesce(h2h_home_run_diff, 0.0::double) as h2h_home_run_diff, coalesce(home_prior_win_pct, 0.5::double) as home_prior_win_pct, coalesce(away_prior_win_pct, 0.5::double) as away_prior_win_pct,
 coalesce(home_rolling_rd - away_rolling_rd, 0.0::double) as rd_diff, coalesce(home_rolling_rs - away_rolling_rs, 0.0::double) as rs_diff, coalesce(home_last7_rd - away_last7_rd, 0.0::double) as last7_rd_diff, coalesce(home_momentum - away_momentum, 0.0::double) as momentum_diff,
 cast(home_streak - away_streak as double) as streak_diff, coalesce(home_home_rd - away_away_rd, 0.0::double) as rd_venue_diff, coalesce(home_season_win_pct, 0.5::double) - coalesce(away_season_win_pct, 0.5::double) as season_win_pct_diff,
 coalesce(home_prior_win_pct, 0.5::double) - coalesce(away_prior_win_pct, 0.5::double) as prior_win_pct_diff, coalesce(home_season_win_pct - home_prior_win_pct, 0.0::double) as home_season_win_pct_delta,
 cast(month(game_date) as double) as game_month, cast(dayofyear(game_date) as double) as game_day_of_year from w where home_rolling_rd is not null and away_rolling_rd is not null"""
_MATRIX_COLS = ("game_pk home_rolling_rd away_rolling_rd home_rolling_rs away_rolling_rs home_last7_rd away_last7_rd home_momentum away_momentum home_streak away_streak home_season_win_pct away_season_win_pct home_home_rd away_away_rd "
                "h2h_home_win_rate h2h_home_run_diff home_prior_win_pct away_prior_win_pct rd_diff rs_diff last7_rd_diff momentum_diff streak_diff rd_venue_diff season_win_pct_diff prior_win_pct_diff home_season_win_pct_delta game_month game_day_of_year").split()
MATRIX_CTX = {"form_rows": _FORM_ROWS, "form": _FORM, "h2h": _H2H, "pyth": _PYTH, "prior": _PRIOR}


@query("feature_matrix", f"select * from ({_MATRIX}) z", MATRIX_CTX)
def feature_matrix(t):
    return matrix.form_matrix(t.games_v).select(*_MATRIX_COLS)


# --- all groups together

def build_full(t, shelf=None):
    """Every feature group of the matrix, one row per staffed game.

    What several groups read (games, dated appearances, a pitcher's and a team's values of
    a season, run values) is put on a shelf first, and so is every group that takes exchanges;
    the groups then meet by game without any. Tables are written one after the other, those
    with the largest exchanges first, and what no later group reads is dropped, so that the
    disk holds one job's exchanges and little that is no longer read.
    """
    shelf = shelf or Shelf(t.spark)
    by_game = lambda name, df, dealt=True: shelf.put(name, df, ["game_pk"], dealt)
    parks = teams.parks(t.spark)
    games = shelf.put("games", t.games_v, ["game_pk"])
    lines = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice").repartition("l_orderkey")
    apps = t.sql(VIEWS["dated_appearances_v"], games_v=games, appearances_v=t.sql(VIEWS["appearances_v"], lineitem=lines))
    apps = shelf.put("appearances", apps, ["pitcher_id", "game_date"])
    team_form = form.team_form(games, shelf)
    meetings = by_game("meetings", form.head_to_head(games), dealt=False)
    g = by_game("staffed", t.sql(VIEWS["staffed_games_v"], games_v=games, starters_v=t.sql(VIEWS["starters_v"], appearances_v=apps)), dealt=False)
    fine = by_game("values", plays.summed_values(_values(t, plays_v=t.sql(VIEWS["impact_plays_v"], games_v=games), shelf=shelf)))
    shelf.drop("runs_to_end")
    impact = plays.impact_form(g, fine, shelf)
    impact = impact.select("game_pk", *[x for x in impact.columns if x.startswith(("home_", "away_"))])
    shelf.drop("values")
    splits = shelf.put("splits", t.sql(_SPLITS, dated_appearances_v=apps), ["team", "season"])
    ops = a.weighted_mean(splits.withColumn("team_ops", c("ops_vs_lhp")), ["team", "season"], ["team_ops"], "pa_vs_lhp")
    team_ops = by_game("team_ops", batting.prior_season_attach(g, ops, ["team_ops"]))
    hand = lambda s: F.when(c(f"{s}_sp_id") % 3 == 0, "L").when(c(f"{s}_sp_id") % 3 == 1, "R")
    handed = g.withColumns({"home_sp_throws": hand("home"), "away_sp_throws": hand("away")}).join(team_ops, "game_pk")
    # the lines of a game are dealt by game alone, as the sides of games lie
    lineups = batting.lineup_splits(handed, _lineups(t, ["game_pk"]), t.sql(_BATTERS), shelf=shelf).drop("lineup_ops_vs_sp_diff")
    pf = shelf.put("factors", a.park_factor(games), ["team", "season"])
    bullpen = by_game("bullpen", pitching.bullpen(games, apps, pf))
    starter_form = by_game("starter_form", pitching.starter_form(g, apps, pf))
    contact = apps.select("team", "season", c("runs_allowed").alias("barrels"), c("outs_recorded").alias("bbe"), c("is_starter").alias("hard_hit"))
    contact = by_game("contact", batting.prior_season_attach(games, batting.contact_quality(contact), ["barrel_pct", "hard_hit_pct"]))
    stats = shelf.put("stats", t.sql(VIEWS["pitcher_stats_v"], dated_appearances_v=apps), ["name_norm", "season"])
    shelf.drop("appearances")
    stuff = by_game("stuff", pitching.stuff_attach(g, t.sql(_STUFF_V, pitcher_stats_v=stats)).drop("home_sp_throws", "away_sp_throws"))
    starter_era = by_game("starter_era", pitching.starter_era(g, stats, pf).drop("home_sp_era_tier", "away_sp_era_tier"))
    shelf.drop("stats")
    lists = t.snapshots_v.withColumn("il_war", c("il_count") % 13)
    rest, injured = by_game("rest", env.rest_and_travel(games, parks)), by_game("injured", env.injured_lists(games, lists).drop("il_diff"))
    prior, hands = by_game("prior", form.prior_pythagorean(games)), by_game("hands", batting.handedness_splits(handed, splits))
    umpires = env.umpire_factor(games.withColumn("ump", c("game_pk") % 97), league_as_of=True).select("game_pk", "ump_run_factor")
    umpires = by_game("umpires", umpires, dealt=False)
    weather = by_game("weather", env.weather(games, t.sql(_WX, games_v=games), parks), dealt=False)
    groups = [team_form, meetings, prior, starter_era, stuff, rest, starter_form, bullpen, hands, injured, contact, lineups, impact]
    factors = F.broadcast(pf.select(c("team").alias("home_team"), "season", "park_factor"))
    light = [team_ops, umpires, weather, env.park_dimensions(games, parks),
             games.join(factors, ["home_team", "season"], "left").select("game_pk", "park_factor"),
             t.odds_v.select("game_pk", c("p_market").alias("vegas_home_prob"))]
    return matrix.feature_matrix(g, [*groups, *light])


_SIZES = ["lf_dist", "cf_dist", "rf_dist", "lf_wall_ht", "altitude_ft"]


_BLENDED = [f"sp_{x}_diff" for x in pitching.STUFF]


def _two(*names):
    return [f"{s}_{x}" for x in names for s in ("home", "away")]


def _full_sql():
    """The groups' own SQL side by side, with differences, neutral values and calendar columns."""
    own = {
        "team_form": _two(*_FORM_COLS), "head_to_head": ["h2h_home_win_rate", "h2h_home_run_diff"], "prior_pythagorean": _two("prior_win_pct"), "starter_era": _two("sp_era", "sp_era_adj"),
        "stuff_attach": _two(*[f"sp_{x}" for x in pitching.STUFF], "sp_pa"), "rest_and_travel": _two("days_rest", "travel_milli"), "starter_workload": _two("sp_days_rest", "sp_outs_last"),
        "starter_inseason": _two("sp_inseason_era", "sp_last3_era"), "bullpen_form": _two("bullpen_inseason_era", "bullpen_outs_3d"), "contact_quality": _two("barrel_pct", "hard_hit_pct"),
        "injured_lists": _two("il_count", "il_war"), "lineup_splits": _two("lineup_ops_vs_lhp", "lineup_ops_vs_rhp", "lineup_ops_vs_sp", "lineup_known_batters"),
        "handedness_splits": _two("batting_ops_vs_sp", "opp_sp_is_lhp", "sp_is_lhp") + ["both_sp_same_hand"], "umpire_factor_as_of": ["ump_run_factor"],
        "weather_attach": ["temp_f", "wind_speed_mph", "humidity_pct", "wind_milli"], "park_factor_attach": ["park_factor"], "impact_form": _two("offense_re24_15g", "sp_re24_last3", "bullpen_re24_15d")}
    tables = {f"q_{n}": ORACLE[n] for n in own}
    joins = [f"left join q_{n} on q_{n}.game_pk = g.game_pk" for n in own]
    joins += [f"left join rates {s} on {s}.team = g.{s}_team and {s}.season + 1 = g.season" for s in ("home", "away")]
    raw = {x: f"q_{n}.{x}" for n, cols in own.items() for x in cols}
    raw |= {f"{s}_team_ops": f"{s}.v" for s in ("home", "away")} | {f"{s}_platoon_advantage": f"q_handedness_splits.{s}_batting_ops_vs_sp - {s}.v" for s in ("home", "away")}
    raw |= {f"park_{x}": f"k.{x}" for x in _SIZES} | {"vegas_home_prob": "o.p_market"}
    wide = (f"select {', '.join('g.' + x for x in matrix.IDS)}, {', '.join(f'{e} as {n}' for n, e in raw.items())} from staffed_games_v g {' '.join(joins)} "
            "left join parks k on k.team = g.home_team left join odds_v o on o.game_pk = g.game_pk")
    firsts = {n: ab for n, ab in matrix.FIRST_DIFFS.items() if set(ab) <= set(raw)}
    step = f"select *, {', '.join(f'{x} - {y} as {n}' for n, (x, y) in firsts.items())} from wide"
    neutral = {**defaults.NEUTRAL, "away_travel_milli": 0, "wind_milli": 0}

    def filled(n):
        v = neutral.get(n, 0.0 if n.endswith(ZERO_ENDINGS) else None)
        kind = "bigint" if n.endswith("milli") else "double"
        return n if v is None else f"coalesce(cast({n} as {kind}), {v}::{kind}) as {n}"

    named = {**raw, **firsts}
    again = {n: ab for n, ab in defaults.DIFF_PAIRS.items() if set(ab) <= set(named)}
    cols = ", ".join([*matrix.IDS, *map(filled, named)])
    last = ", ".join(f"coalesce({x} - {y}, 0.0::double) as {n}" for n, (x, y) in again.items())
    day = ("cast(month(game_date) as double) as game_month, cast(dayofyear(game_date) as double) as game_day_of_year, cast(month(game_date) in (3, 4) as double) as is_early_season, "
           "cast(year(game_date) >= 2023 as double) as post_2023_rules")
    # differences of blended values, in millionths, since their last digit is rounding
    micro = ", ".join(f"cast(floor({n} * 1000000 + 0.5) as bigint) as {n}" for n in _BLENDED)
    fill = f"select {cols}, {day} from firsts where home_rolling_rd is not null and away_rolling_rd is not null"
    out = f"select * replace ({micro}) from (select * exclude ({', '.join(n for n in again if n in named)}), {last} from filled) y"
    rates = (f"select team, season, cast(sum(cast(ops_vs_lhp * w as decimal(18,8))) as double) / cast(sum(cast(w as decimal(18,8))) as double) as v "
             f"from (select *, greatest(coalesce(cast(pa_vs_lhp as double), 1.0::double), 1.0::double) as w from ({_SPLITS}) s0) s1 group by 1, 2")
    return out, {**PARKS, "rates": rates, **tables, "wide": wide, "firsts": step, "filled": fill}


@query("full_feature_matrix", *_full_sql())
def full_feature_matrix(t):
    """Trips and wind in thousandths, as in the groups' own queries; differences of blended values in millionths."""
    out = build_full(t)
    milli = {n: F.floor(c(x) * 1000 + 0.5).cast("bigint") for n, x in (("home_travel_milli", "home_travel_miles"), ("away_travel_milli", "away_travel_miles"), ("wind_milli", "wind_to_cf"))}
    milli |= {n: F.floor(c(n) * 1000000 + 0.5).cast("bigint") for n in _BLENDED}
    return out.withColumns(milli).drop("home_travel_miles", "away_travel_miles", "travel_diff", "wind_to_cf")


_REQ = "select o_orderkey as game_pk, cast(o_orderdate as date) + 1 as game_date, cast(year(cast(o_orderdate as date) + 1) as int) as season, cast(o_orderkey % 30 as int) as home_team, cast((o_orderkey % 30 + 1 + o_custkey % 29) % 30 as int) as away_team from orders"


@query("matchup_rows", f"""
with side as (select game_pk, game_date, season, 'home' as venue, home_team as team, away_team as opp, home_team as place from req union all select game_pk, game_date, season, 'away', away_team, home_team, home_team from req),
af as (select team, game_date, arg_max(rolling_rd, game_pk) as x, last(rolling_rd order by game_pk) as rolling_rd, last(rolling_rs order by game_pk) as rolling_rs, last(last7_rd order by game_pk) as last7_rd, last(last7_rd - rolling_rd order by game_pk) as momentum, last(streak order by game_pk) as streak,
  last(season_win_pct order by game_pk) as season_win_pct, last(season order by game_pk) as season, last(case when venue = 'home' then team else opponent end order by game_pk) as place from after_rows group by 1, 2),
mt as (select team, opponent, game_date, last(w order by game_pk) as h2h_win_rate, last(d order by game_pk) as h2h_run_diff from (select team, opponent, game_date, game_pk, case when count(*) over v >= 3 then avg(case when run_diff > 0 then 1 else 0 end) over v end as w, case when count(*) over v >= 3 then avg(run_diff) over v end as d from team_games_v
  window v as (partition by team, opponent order by game_date, game_pk rows between 9 preceding and current row)) k group by 1, 2, 3),
b3 as (select s.game_pk, s.venue, cast(sum(a.outs_recorded) as bigint) as o from side s left join dated_appearances_v a on a.team = s.team and a.is_starter = 0 and a.game_date < s.game_date and a.game_date >= s.game_date - interval 3 days group by 1, 2),
rows as (select s.game_pk, s.venue, f.rolling_rd, f.rolling_rs, f.last7_rd, f.momentum, f.streak, case when f.season = s.season then f.season_win_pct end as season_win_pct, greatest(0, least(7, cast(s.game_date - f.game_date as int) - 1)) as days_rest,
  case when f.place = s.place then 0 else cast(floor(2 * 3958.8 * asin(sqrt(power(sin(radians(pb.lat - pa.lat) / 2), 2) + cos(radians(pa.lat)) * cos(radians(pb.lat)) * power(sin(radians(pb.lon - pa.lon) / 2), 2))) * 1000 + 0.5) as bigint) end as travel_milli,
  i.il_count, b3.o as bullpen_outs_3d, m.h2h_win_rate, m.h2h_run_diff
 from side s asof left join af f on f.team = s.team and f.game_date < s.game_date asof left join snapshots_v i on i.team = s.team and i.snap_date <= s.game_date asof left join mt m on m.team = s.team and m.opponent = s.opp and m.game_date < s.game_date
 left join b3 on b3.game_pk = s.game_pk and b3.venue = s.venue left join parks pa on pa.team = f.place left join parks pb on pb.team = s.place)
select * exclude (away_h2h_win_rate, away_h2h_run_diff, home_h2h_win_rate, home_h2h_run_diff), home_h2h_win_rate as h2h_home_win_rate, home_h2h_run_diff as h2h_home_run_diff
from ({pivot(scoring.STATE + ['days_rest', 'travel_milli', 'il_count', 'bullpen_outs_3d', 'h2h_win_rate', 'h2h_run_diff'], 'rows')}) y""".replace("with side as", "select * from (with side as") + ") z", {"req": _REQ, "after_rows": _AFTER, **PARKS})
def matchup_rows(t):
    req = t.sql(_REQ)
    relief = t.dated_appearances_v.filter("is_starter = 0")
    out = scoring.matchup_rows(req, t.games_v, t.snapshots_v, relief, teams.parks(t.spark), Shelf(t.spark))
    milli = {f"{s}_travel_milli": F.floor(c(f"{s}_travel_miles") * 1000 + 0.5).cast("bigint") for s in ("home", "away")}
    return out.withColumns(milli).drop("home_travel_miles", "away_travel_miles")


@query("resolve_hands", """
select c_custkey, 'n' || c_custkey % 700 as name_norm, coalesce(r.h, s.h) as throws, case when r.h is not null then 'register' when s.h is not null then 'name' else 'none' end as hand_source
from customer left join (select s_suppkey as id, case when s_nationkey % 3 = 0 then 'L' when s_nationkey % 3 = 1 then 'R' end as h from supplier) r on r.id = c_custkey
left join (select 'n' || p_partkey % 900 as nm, arg_max(case when p_size % 2 = 0 then 'L' else 'R' end, (p_size, case when p_size % 2 = 0 then 'L' else 'R' end)) as h from part where p_partkey % 4 <> 0 group by 1) s on s.nm = 'n' || c_custkey % 700""")
def resolve_hands(t):
    pairs = t.customer.select("c_custkey", F.concat(F.lit("n"), (c("c_custkey") % 700).cast("string")).alias("name_norm"), c("c_custkey").alias("source_id"))
    reg = t.supplier.select(c("s_suppkey").alias("source_id"), F.when(c("s_nationkey") % 3 == 0, " l").when(c("s_nationkey") % 3 == 1, "R").otherwise("?").alias("throws"))
    stuff = t.part.select(F.concat(F.lit("n"), (c("p_partkey") % 900).cast("string")).alias("name_norm"), c("p_size").alias("season"),
                          F.when(c("p_partkey") % 4 == 0, "-").when(c("p_size") % 2 == 0, "L").otherwise("R").alias("throws"))
    return pitching.resolve_hands(pairs, reg, stuff).drop("source_id")
