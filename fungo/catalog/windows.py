"""Event-time windows (prior rows only)."""

from pyspark.sql import functions as F

from fungo.catalog import query
from fungo.operators import ordered as o

TEAM = dict(keys=["team"], order=["game_date", "game_pk"])


@query("rolling_prior_mean", """
select game_pk, team,
 case when count(run_diff) over w15 >= 5 then avg(run_diff) over w15 end as rd15,
 case when count(rf) over w15 >= 5 then avg(rf) over w15 end as rs15,
 case when count(run_diff) over w7 >= 3 then avg(run_diff) over w7 end as rd7
from team_games_v
window w15 as (partition by team order by game_date, game_pk rows between 15 preceding and 1 preceding),
 w7 as (partition by team order by game_date, game_pk rows between 7 preceding and 1 preceding)""")
def rolling_prior_mean(t):
    return o.rolling_prior(t.team_games_v, **TEAM, aggs={
        "rd15": ("avg", "run_diff", 15, 5), "rs15": ("avg", "rf", 15, 5), "rd7": ("avg", "run_diff", 7, 3),
    }).select("game_pk", "team", "rd15", "rs15", "rd7")


@query("rolling_prior_sum_ratio", """
select game_pk, pitcher_id,
 case when count(*) over w5 >= 2 and sum(outs_recorded) over w5 >= 1
  then cast(sum(runs_allowed) over w5 as double) * 27 / sum(outs_recorded) over w5 end as ra9_5,
 case when count(*) over w3 >= 2 and sum(outs_recorded) over w3 >= 1
  then cast(sum(runs_allowed) over w3 as double) * 27 / sum(outs_recorded) over w3 end as ra9_3
from dated_appearances_v where is_starter = 1
window w5 as (partition by pitcher_id order by game_date, game_pk rows between 5 preceding and 1 preceding),
 w3 as (partition by pitcher_id order by game_date, game_pk rows between 3 preceding and 1 preceding)""")
def rolling_prior_sum_ratio(t):
    starts = t.dated_appearances_v.filter("is_starter = 1")
    out = o.rolling_prior(starts, ["pitcher_id"], ["game_date", "game_pk"], {
        f"{c}{n}": ("sum", col, n, 2) for n in (5, 3) for c, col in (("r", "runs_allowed"), ("o", "outs_recorded"))
    })
    ratio = lambda n: F.when(F.col(f"o{n}") >= 1, F.col(f"r{n}").cast("double") * 27 / F.col(f"o{n}"))
    return out.select("game_pk", "pitcher_id", ratio(5).alias("ra9_5"), ratio(3).alias("ra9_3"))


@query("expanding_season_mean", """
select game_pk, team, case when count(*) over w >= 10 then avg(case when run_diff > 0 then 1 else 0 end) over w end as season_win_pct
from team_games_v
window w as (partition by team, season order by game_date, game_pk rows between unbounded preceding and 1 preceding)""")
def expanding_season_mean(t):
    win = F.when(F.col("run_diff") > 0, 1).otherwise(0)
    out = o.expanding_prior(t.team_games_v, ["team", "season"], ["game_date", "game_pk"], {"season_win_pct": (win, 10)})
    return out.select("game_pk", "team", "season_win_pct")


@query("calendar_range_sum", """
select team, game_date, cast(coalesce(sum(o) over w, 0) as bigint) as outs_3d
from (select team, game_date, sum(outs_recorded) as o from dated_appearances_v where is_starter = 0 group by team, game_date) d
window w as (partition by team order by game_date range between interval 3 days preceding and interval 1 day preceding)""")
def calendar_range_sum(t):
    relief = t.dated_appearances_v.filter("is_starter = 0")
    out = o.calendar_range(relief, ["team"], "game_date", {"outs_3d": ("sum", "outs_recorded")}, 3)
    return out.select("team", "game_date", F.coalesce("outs_3d", F.lit(0)).alias("outs_3d"))


@query("calendar_range_mean", """
select team, game_date, cast(sum(s) over w as double) / sum(n) over w as mean_rd_15d
from (select team, game_date, sum(run_diff) as s, count(*) as n from team_games_v group by team, game_date) d
window w as (partition by team order by game_date range between interval 15 days preceding and interval 1 day preceding)""")
def calendar_range_mean(t):
    return o.calendar_range(t.team_games_v, ["team"], "game_date", {"mean_rd_15d": ("avg", "run_diff")}, 15)


@query("signed_streak", """
select game_pk, team, cast(coalesce(lag(case when s > 0 then n else -n end) over (partition by team order by game_date, game_pk), 0) as bigint) as streak
from (select *, row_number() over (partition by team, isl order by game_date, game_pk) as n from (
  select *, sum(chg) over (partition by team order by game_date, game_pk rows unbounded preceding) as isl from (
    select *, case when s = lag(s) over (partition by team order by game_date, game_pk) then 0 else 1 end as chg
    from (select game_pk, team, game_date, case when run_diff > 0 then 1 else -1 end as s from team_games_v) a) b) c) d""")
def signed_streak(t):
    return o.signed_streak(t.team_games_v, **TEAM, value="run_diff").select("game_pk", "team", "streak")


@query("occurrence_number", """
select game_pk, cast(row_number() over (partition by game_date, home_team, away_team order by game_pk) as int) as occurrence from games_v""")
def occurrence_number(t):
    games = t.games_v.drop("game_number").withColumn("_cell", F.floor(F.col("game_pk") / 4096))
    out = o.occurrence_number(games, ["game_date", "home_team", "away_team"], ["game_pk"], "occurrence", cell="_cell")
    return out.select("game_pk", "occurrence")


@query("conditional_rolling", """
select game_pk, team, venue, case when count(*) over w >= 3 then avg(run_diff) over w end as venue_rd
from team_games_v
window w as (partition by team, venue order by game_date, game_pk rows between 15 preceding and 1 preceding)""")
def conditional_rolling(t):
    out = o.rolling_prior(t.team_games_v, ["team", "venue"], ["game_date", "game_pk"], {"venue_rd": ("avg", "run_diff", 15, 3)})
    return out.select("game_pk", "team", "venue", "venue_rd")


@query("rest_days", """
select game_pk, team, least(7, greatest(0, cast(game_date - lag(game_date) over (partition by team order by game_date, game_pk) as int) - 1)) as rest
from team_games_v
qualify lag(game_date) over (partition by team order by game_date, game_pk) is not null
union all
select game_pk, team, null from team_games_v qualify row_number() over (partition by team order by game_date, game_pk) = 1""")
def rest_days(t):
    return o.rest_days(t.team_games_v, **TEAM, day="game_date", cap=7).select("game_pk", "team", "rest")


@query("previous_value", """
select game_pk, pitcher_id, lag(outs_recorded) over (partition by pitcher_id order by game_date, game_pk) as outs_last
from dated_appearances_v where is_starter = 1""")
def previous_value(t):
    starts = t.dated_appearances_v.filter("is_starter = 1")
    out = o.previous(starts, ["pitcher_id"], ["game_date", "game_pk"], {"outs_last": "outs_recorded"})
    return out.select("game_pk", "pitcher_id", "outs_last")


@query("pair_rolling", """
select game_pk, home_team, away_team,
 case when n >= 3 then win_rate end as h2h_home_win_rate, case when n >= 3 then rd end as h2h_home_run_diff
from (select game_pk, team as home_team, opponent as away_team, venue, count(*) over w as n,
  avg(case when run_diff > 0 then 1 else 0 end) over w as win_rate, avg(run_diff) over w as rd
 from team_games_v window w as (partition by team, opponent order by game_date, game_pk rows between 10 preceding and 1 preceding)) x
where venue = 'home'""")
def pair_rolling(t):
    win = F.when(F.col("run_diff") > 0, 1).otherwise(0)
    out = o.rolling_prior(t.team_games_v, ["team", "opponent"], ["game_date", "game_pk"], {
        "h2h_home_win_rate": ("avg", win, 10, 3), "h2h_home_run_diff": ("avg", "run_diff", 10, 3)})
    return out.filter("venue = 'home'").select(
        "game_pk", F.col("team").alias("home_team"), F.col("opponent").alias("away_team"),
        "h2h_home_win_rate", "h2h_home_run_diff")


@query("prior_rows_15", """
select team, game_date, case when count(*) over w >= 5 and sum(o) over w >= 1 then cast(sum(r) over w as double) * 27 / sum(o) over w end as bullpen_ra9
from (select team, game_date, sum(runs_allowed) as r, sum(outs_recorded) as o from dated_appearances_v where is_starter = 0 group by team, game_date) d
window w as (partition by team order by game_date rows between 15 preceding and 1 preceding)""")
def prior_rows_15(t):
    days = t.dated_appearances_v.filter("is_starter = 0").groupBy("team", "game_date").agg(
        F.sum("runs_allowed").alias("r"), F.sum("outs_recorded").alias("o"))
    out = o.rolling_prior(days, ["team"], ["game_date"], {"rs": ("sum", "r", 15, 5), "os": ("sum", "o", 15, 5)})
    return out.select("team", "game_date",
                      F.when(F.col("os") >= 1, F.col("rs").cast("double") * 27 / F.col("os")).alias("bullpen_ra9"))


@query("running_in_group", """
select play_id, cast(coalesce(sum(runs_scored) over (partition by user_id, play_date order by ts, play_id rows between unbounded preceding and 1 preceding), 0) as bigint) as runs_before
from plays_v""")
def running_in_group(t):
    plays = t.plays_v.withColumn("_hour", F.date_trunc("hour", "ts"))
    out = o.expanding(plays, ["user_id", "play_date"], ["ts", "play_id"], {"runs_before": ("sum", "runs_scored")}, cell="_hour")
    return out.select("play_id", F.coalesce("runs_before", F.lit(0)).alias("runs_before"))


@query("expanding_entity_ratio", """
select game_pk, ump, coalesce(case when n >= 20 then m / lg end, 1.0) as ump_run_factor
from (select u.*, avg(runs) over (partition by ump order by game_date, game_pk rows between unbounded preceding and 1 preceding) as m,
  count(*) over (partition by ump order by game_date, game_pk rows between unbounded preceding and 1 preceding) as n,
  l.lg from (select game_pk, game_date, season, game_pk % 97 as ump, home_runs + away_runs as runs from games_v) u
 join (select season, avg(home_runs + away_runs) as lg from games_v group by season) l on u.season = l.season) x""")
def expanding_entity_ratio(t):
    from fungo.plans.environment import umpire_factor
    games = t.games_v.withColumn("ump", F.col("game_pk") % 97)
    return umpire_factor(games).select("game_pk", "ump", "ump_run_factor")


@query("latest_snapshot", """
select team, game_pk, game_date, opponent, run_diff from team_games_v
qualify row_number() over (partition by team order by game_date desc, game_pk desc) = 1""")
def latest_snapshot(t):
    return o.latest(t.team_games_v, ["team"], ["game_date", "game_pk"], ["game_pk", "game_date", "opponent", "run_diff"])


@query("first_in_group", """
select game_pk, team_side, pitcher_id from appearances_v
qualify row_number() over (partition by game_pk, team_side order by is_starter desc, pitcher_id) = 1""")
def first_in_group(t):
    apps = t.appearances_v.withColumn("_late", 1 - F.col("is_starter"))
    return o.first(apps, ["game_pk", "team_side"], ["_late", "pitcher_id"], ["pitcher_id"])


_VARIANTS = ((5, 2), (10, 3), (15, 5), (20, 5), (30, 10))


@query("window_variants", "select game_pk, team, " + ", ".join(
    f"case when count(*) over w{n} >= {m} then avg(run_diff) over w{n} end as rd{n}" for n, m in _VARIANTS)
    + " from team_games_v window " + ", ".join(
    f"w{n} as (partition by team order by game_date, game_pk rows between {n} preceding and 1 preceding)" for n, _ in _VARIANTS))
def window_variants(t):
    out = o.rolling_prior(t.team_games_v, **TEAM, aggs={f"rd{n}": ("avg", "run_diff", n, m) for n, m in _VARIANTS})
    return out.select("game_pk", "team", *[f"rd{n}" for n, _ in _VARIANTS])


@query("momentum", """
select game_pk, team, case when n7 >= 3 and n15 >= 5 then m7 - m15 end as momentum
from (select game_pk, team, avg(run_diff) over w7 as m7, count(*) over w7 as n7, avg(run_diff) over w15 as m15, count(*) over w15 as n15
from team_games_v
window w15 as (partition by team order by game_date, game_pk rows between 15 preceding and 1 preceding),
 w7 as (partition by team order by game_date, game_pk rows between 7 preceding and 1 preceding)) x""")
def momentum(t):
    out = o.rolling_prior(t.team_games_v, **TEAM, aggs={"m15": ("avg", "run_diff", 15, 5), "m7": ("avg", "run_diff", 7, 3)})
    return out.select("game_pk", "team", (F.col("m7") - F.col("m15")).alias("momentum"))


@query("latest_balance", """
select c.c_custkey as account, x.o_totalprice as balance from customer c join (
 select o_custkey, o_totalprice from orders where o_orderstatus <> 'P'
 qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) x on x.o_custkey = c.c_custkey""")
def latest_balance(t):
    booked = t.orders.select(F.col("o_custkey").alias("account"), "o_orderdate", "o_orderkey",
                             F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("balance"))
    seen = booked.filter(F.col("balance").isNotNull())
    out = o.latest(seen, ["account"], ["o_orderdate", "o_orderkey"], ["balance"])
    return out.join(t.customer.select(F.col("c_custkey").alias("account")), "account", "left_semi")


@query("last_non_null", """
select game_pk, team, last_value(case when game_pk % 3 = 0 then null else game_pk % 50 end ignore nulls) over (
 partition by team order by game_date, game_pk rows between unbounded preceding and 1 preceding) as last_starter
from team_games_v""")
def last_non_null(t):
    starter = F.when(F.col("game_pk") % 3 != 0, F.col("game_pk") % 50)
    out = o.expanding(t.team_games_v, **TEAM, aggs={"last_starter": ("last", starter)})
    return out.select("game_pk", "team", "last_starter")
