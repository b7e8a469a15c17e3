"""Joins."""

from pyspark.sql import functions as F

from fungo.catalog import query
from fungo.functions import odds, teams
from fungo.operators import joins as j, ordered as o

c = F.col


@query("game_key_join", """
select g.game_pk, w.total from games_v g left join (
 select game_date, home_team, away_team, game_number, home_runs + away_runs as total from games_v where game_pk % 4 <> 0) w
 on g.game_date = w.game_date and g.home_team = w.home_team and g.away_team = w.away_team and g.game_number = w.game_number""")
def game_key_join(t):
    other = t.games_v.filter("game_pk % 4 <> 0").select(
        "game_date", "home_team", "away_team", "game_number", (c("home_runs") + c("away_runs")).alias("total"))
    return j.game_key_join(t.games_v, other).select("game_pk", "total")


_SEASON = "select team, season, avg(rf) as rpg from team_games_v group by team, season"


@query("prior_season_join", f"""
select g.game_pk, g.team, p.rpg as prior_rpg from team_games_v g left join ({_SEASON}) p on p.team = g.team and p.season + 1 = g.season""")
def prior_season_join(t):
    dim = t.team_games_v.groupBy("team", "season").agg(F.avg("rf").alias("prior_rpg"))
    return j.prior_season_join(t.team_games_v, dim, ["team"]).select("game_pk", "team", "prior_rpg")


@query("two_sided_dim_join", f"""
select g.game_pk, h.rpg as home_rpg, a.rpg as away_rpg from games_v g
 left join ({_SEASON}) h on h.team = g.home_team and h.season = g.season
 left join ({_SEASON}) a on a.team = g.away_team and a.season = g.season""")
def two_sided_dim_join(t):
    dim = t.team_games_v.groupBy("team", "season").agg(F.avg("rf").alias("rpg"))
    return j.two_sided_dim_join(t.games_v, dim, "team", ["season"]).select("game_pk", "home_rpg", "away_rpg")


@query("dict_lookup_join", """
select g.game_pk, p.code, p.cf_dist, p.altitude_ft from games_v g left join parks p on p.team = g.home_team""", {"parks": teams.parks_sql()})
def dict_lookup_join(t):
    return j.dict_lookup_join(t.games_v, teams.parks(t.spark), "home_team", "team").select("game_pk", "code", "cf_dist", "altitude_ft")


@query("asof_backward_join", """
select g.game_pk, g.team, s.snap_date as snap_date_asof, s.il_count from team_games_v g
 asof left join snapshots_v s on s.team = g.team and s.snap_date <= g.game_date""")
def asof_backward_join(t):
    out = j.asof_join(t.team_games_v, t.snapshots_v, ["team"], "game_date", "snap_date", ["il_count"],
                      cell=F.trunc("_at", "month"))
    return out.select("game_pk", "team", "snap_date_asof", "il_count")


@query("asof_point_lookup", """
select r.order_id, r.user_id, p.ts as ts_asof, p.runs_scored from (
 select o_orderkey as order_id, o_custkey % 100 as user_id, date '2024-01-01' + cast(o_orderkey % 31 as int) + interval 12 hours as at from orders) r
 asof left join (select user_id, ts, max_by(runs_scored, play_id) as runs_scored from plays_v group by user_id, ts) p on p.user_id = r.user_id and p.ts < r.at""")
def asof_point_lookup(t):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (c("o_orderkey") % 31).cast("int"))
    asks = t.orders.select(c("o_orderkey").alias("order_id"), (c("o_custkey") % 100).alias("user_id"),
                           (day.cast("timestamp_ntz") + F.expr("interval 12 hours")).alias("at"))
    out = j.asof_join(asks, t.plays_v, ["user_id"], "at", "ts", ["runs_scored"], inclusive=False, right_tie=["play_id"])
    return out.select("order_id", "user_id", "ts_asof", "runs_scored")


_STUFF = "select p.pitcher_id, p.season, max(p.team) as team, cast(sum(outs_recorded) as bigint) as outs from dated_appearances_v p where (p.pitcher_id + p.season) % 3 <> 0 and p.pitcher_id % 10 <> 7 group by p.pitcher_id, p.season"


@query("entity_fallback_join", f"""
select a.game_pk, a.pitcher_id, coalesce(c.outs, p.outs, m.outs) as outs,
 case when c.outs is not null then 'season' when p.outs is not null then 'prior season' when m.outs is not null then 'team' else 'none' end as match_tier
from dated_appearances_v a left join stuff c on c.pitcher_id = a.pitcher_id and c.season = a.season
 left join stuff p on p.pitcher_id = a.pitcher_id and p.season + 1 = a.season
 left join (select team, season, cast(max(outs) as bigint) as outs from stuff group by team, season) m on m.team = a.team and m.season = a.season""",
       {"stuff": _STUFF})
def entity_fallback_join(t):
    known = t.dated_appearances_v.filter("(pitcher_id + season) % 3 <> 0 and pitcher_id % 10 <> 7")
    stuff = known.groupBy("pitcher_id", "season").agg(F.max("team").alias("team"), F.sum("outs_recorded").alias("outs"))
    team = stuff.groupBy("team", "season").agg(F.max("outs").alias("outs"))
    out = j.entity_fallback_join(t.dated_appearances_v, [
        ("season", stuff.drop("team"), ["pitcher_id", "season"]),
        ("prior season", stuff.drop("team").withColumn("season", c("season") + 1), ["pitcher_id", "season"]),
        ("team", team, ["team", "season"])], ["outs"])
    return out.select("game_pk", "pitcher_id", "outs", "match_tier")


_VAL = "select pitcher_id, season, cast(sum(outs_recorded) as bigint) as war from dated_appearances_v where pitcher_id % 4 <> 0 group by pitcher_id, season having sum(outs_recorded) % 3 <> 0"


@query("war_fallback_join", f"""
select r.game_pk, cast(sum(coalesce(a.war, b.war, 0)) as bigint) as roster_war from (select distinct game_pk, season, pitcher_id from dated_appearances_v) r
 left join val a on a.pitcher_id = r.pitcher_id and a.season + 1 = r.season
 left join val b on b.pitcher_id = r.pitcher_id and b.season + 2 = r.season group by r.game_pk""", {"val": _VAL})
def war_fallback_join(t):
    apps = t.dated_appearances_v
    values = apps.filter("pitcher_id % 4 <> 0").groupBy("pitcher_id", "season").agg(F.sum("outs_recorded").alias("war")).filter("war % 3 <> 0")
    people = apps.select("game_pk", "season", "pitcher_id").distinct()
    return j.war_fallback_join(people, values, ["game_pk"], "season", "pitcher_id", "war", "roster_war")


@query("odds_inner_join", """
select g.game_pk, o.home_ml, o.away_ml from games_v g join odds_v o on o.game_pk = g.game_pk where o.game_pk % 6 <> 0""")
def odds_inner_join(t):
    prices = t.odds_v.withColumn("home_ml", F.when(c("game_pk") % 6 != 0, c("home_ml")))
    return t.games_v.join(prices, "game_pk").dropna(subset=["home_ml", "away_ml"]).select("game_pk", "home_ml", "away_ml")


@query("anti_seen_keys", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem l where not exists (select 1 from orders o where o.o_orderkey = l.l_orderkey and o.o_orderstatus = 'F')""")
def anti_seen_keys(t):
    seen = t.orders.filter("o_orderstatus = 'F'").select(c("o_orderkey").alias("l_orderkey"))
    return j.anti_seen(t.lineitem, seen, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("semi_membership", """
select game_pk, home_team from games_v where home_team in (select team from snapshots_v where il_count > 15)""")
def semi_membership(t):
    busy = t.snapshots_v.filter("il_count > 15").select(c("team").alias("home_team"))
    return j.semi_membership(t.games_v, busy, ["home_team"]).select("game_pk", "home_team")


@query("window_range_join", """
select g.game_pk, g.team, cast(sum(a.outs_recorded) as bigint) as bullpen_outs_3d from team_games_v g
 left join dated_appearances_v a on a.team = g.team and a.is_starter = 0 and a.game_date < g.game_date and a.game_date >= g.game_date - interval 3 days
group by g.game_pk, g.team""")
def window_range_join(t):
    relief = t.dated_appearances_v.filter("is_starter = 0")
    out = j.window_range_join(t.team_games_v, relief, ["team"], "game_date", 3, {"bullpen_outs_3d": "outs_recorded"})
    return out.select("game_pk", "team", "bullpen_outs_3d")


@query("config_grid_cross", """
select m.threshold, b.bucket, count(*) as bets from (
 select case when home_ml < 100 then 'favorite' else 'underdog' end as bucket, p_model - p_market as edge from odds_v) b
 cross join (select unnest([0.0, 0.02, 0.04, 0.06]::double[]) as threshold) m where b.edge > m.threshold group by 1, 2""")
def config_grid_cross(t):
    b = t.odds_v.select(F.when(c("home_ml") < 100, "favorite").otherwise("underdog").alias("bucket"), (c("p_model") - c("p_market")).alias("edge"))
    out = j.grid_aggregate(b, ["bucket"], {"threshold": [0.0, 0.02, 0.04, 0.06]}, lambda at: {"bets": F.count_if(c("edge") > at["threshold"])})
    return out.filter("bets > 0").select("threshold", "bucket", "bets")


@query("id_crosswalk_join", """
select c.c_custkey, x.s_suppkey, s.s_name from customer c
 left join (select s_nationkey, min(s_suppkey) as s_suppkey from supplier group by 1) x on x.s_nationkey = c.c_nationkey
 left join supplier s on s.s_suppkey = x.s_suppkey""")
def id_crosswalk_join(t):
    fact = t.customer.select("c_custkey", c("c_nationkey").alias("nation"))
    walk = t.supplier.select(c("s_nationkey").alias("nation"), "s_suppkey")
    out = j.id_crosswalk_join(fact, walk, t.supplier.select("s_suppkey", "s_name"), "nation", "s_suppkey", ["s_suppkey"])
    return out.select("c_custkey", "s_suppkey", "s_name")


@query("result_match_join", """
select g.game_pk, case when g.home_runs > g.away_runs then g.home_team else g.away_team end as winner from games_v g where g.game_pk % 3 = 0
union all select game_pk, null from games_v where game_pk % 3 <> 0""")
def result_match_join(t):
    g = t.games_v
    text = lambda x: c(x).cast("string")
    bets = g.select("game_pk", "game_date", "game_number", F.concat_ws(" @ ", text("away_team"), text("home_team")).alias("matchup"))
    finals = g.filter("game_pk % 3 = 0").select(
        "game_date", "game_number", text("home_team").alias("home"), text("away_team").alias("away"),
        F.when(c("home_runs") > c("away_runs"), c("home_team")).otherwise(c("away_team")).alias("winner"))
    return j.result_match_join(bets, finals).select("game_pk", "winner")


@query("pivot_back_join", """
select game_pk, home_win, p_model as model, p_market as market from market_v""")
def pivot_back_join(t):
    from fungo.operators.project import pivot_first
    m = t.market_v
    long = m.select("game_pk", F.inline(F.array(
        F.struct(F.lit("model").alias("name"), c("p_model").alias("p")), F.struct(F.lit("market").alias("name"), c("p_market").alias("p")))))
    wide = pivot_first(long, ["game_pk"], "name", ["model", "market"], "p", "p")
    return j.pivot_back_join(m.select("game_pk", "home_win"), wide, ["game_pk"]).select("game_pk", "home_win", "model", "market")


@query("join_cardinality_guard", "select team, count(*) as days from snapshots_v group by team")
def join_cardinality_guard(t):
    return j.cardinality_guard(t.snapshots_v, ["team", "snap_date"]).groupBy("team").agg(F.count("*").alias("days"))
