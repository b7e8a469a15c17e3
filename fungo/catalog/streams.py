"""Streams over the driver's tables, drained with an available-now trigger."""

from pyspark.sql import functions as F

from fungo.catalog import query
from fungo.catalog.decisions import CAND, DECIDED, RULES_SQL, _KELLY, cents, rules
from fungo.catalog.ingest import scratch
from fungo.operators import decision as d
from fungo.sources.versions import VersionedTable
from fungo.streaming import jobs, run

c = F.col


def _stream(t, name):
    return run.file_stream(t.spark, t.dir, name, getattr(t, name).schema)


def _quotes(t):
    return _stream(t, "events").select(c("event_id").alias("quote_id"), c("ts").cast("timestamp").alias("ts"), c("user_id").alias("game_key"),
                                       c("event_type").alias("book"), c("value").alias("price"))


def _windows(t, length, slide=None):
    parts = run.drain(_quotes(t), scratch(t, "windows"), prepare=lambda batch, n: jobs.quote_parts(batch, length, slide))
    return jobs.merge_quotes(parts).select(c("window_start").cast("timestamp_ntz").alias("window_start"), "game_key", "quotes", "consensus")


_AVG = "cast(sum(cast(price as decimal(18,8))) as double) / count(price)"


@query("quote_windows_tumbling", f"""
select time_bucket(interval 1 day, ts) as window_start, game_key, count(price) as quotes, {_AVG} as consensus from quotes_v group by 1, 2""")
def quote_windows_tumbling(t):
    return _windows(t, "1 day")


@query("quote_windows_sliding", f"""
select time_bucket(interval 6 hours, ts) - k * interval 6 hours as window_start, game_key, count(price) as quotes, {_AVG} as consensus from quotes_v, (select unnest([0, 1]) as k) w group by 1, 2""")
def quote_windows_sliding(t):
    return _windows(t, "12 hours", "6 hours")


def _results(t):
    """Results as a stream: the games view over a stream of orders (game_number is not needed)."""
    return _result_rows(_stream(t, "orders"))


def _result_rows(o):
    cents_ = F.round(c("o_totalprice") * 100).cast("bigint")
    g = o.select(c("o_orderkey").alias("game_pk"), F.to_date("o_orderdate").alias("game_date"), c("o_orderdate").cast("timestamp").alias("ts"),
                 (c("o_custkey") % 30).cast("int").alias("home_team"), ((c("o_custkey") % 30 + 1 + c("o_orderkey") % 29) % 30).cast("int").alias("away_team"),
                 (cents_ % 11).alias("hr"), (F.floor(cents_ / 11).cast("bigint") % 10).alias("ar"))
    return g.select("game_pk", "game_date", F.year("game_date").alias("season"), "ts", "home_team", "away_team",
                    (c("hr") + F.when(c("hr") == c("ar"), 1).otherwise(0)).cast("int").alias("home_runs"), c("ar").cast("int").alias("away_runs"))


def _team_results(t):
    from fungo.plans.sides import team_games
    return team_games(_results(t))


_GAMES = "select m.*, case when game_pk % 9 = 0 then 'Final' else 'Scheduled' end as status, case when game_pk % 13 = 0 then 'TBD' else 'A' end as sp, game_pk % 2 = 0 as hl, game_pk % 3 = 0 as al from market_v m"
_ALERTS = f"""
select game_pk, game_date, alert_type, side, odds, cast(stake * 100 as bigint) as stake_cents, lineup_status, home_team, away_team, ts, start_ts from (
 select *, unnest(case when hl and al then ['early_actionable', 'final_lineup'] else ['early_actionable'] end) as alert_type, case when hl and al then 'both confirmed' when hl or al then 'one confirmed' else 'pending' end as lineup_status from (
  select k.*, x.hl, x.al, cast(round(cast({_KELLY.format(f='0.25::double', c='0.05::double')} * 1000.0::double as decimal(24,6)), 2) as decimal(18,2)) as stake,
   cast(k.game_date as timestamp) + k.game_pk % 24 * interval 1 hour as ts, cast(k.game_date as timestamp) + interval 23 hours as start_ts
  from decided k join gm x on x.game_pk = k.game_pk where should_bet and x.status <> 'Final' and x.sp <> 'TBD') q where stake >= 0.01) z"""
_CAND2 = CAND.replace("from market_v)", "from mk)")
_ACTX = {"mk": "select * replace (ih / (ih + ia) as p_market) from (select *, case when home_ml > 0 then 100 / (home_ml + 100) else abs(home_ml) / (abs(home_ml) + 100) end as ih, case when away_ml > 0 then 100 / (away_ml + 100) else abs(away_ml) / (abs(away_ml) + 100) end as ia from market_v) x",
         "cand": _CAND2, "rules": RULES_SQL, "decided": DECIDED, "gm": _GAMES, "alerts": _ALERTS}


def _alerts(t, gate=None):
    g = c("game_pk")
    quotes = _stream(t, "orders").select(c("o_orderkey").alias("game_pk"), (c("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(c("o_orderkey") % 24).cast("int"))).alias("ts")).join(
        t.odds_v.select("game_pk", "home_ml", "away_ml", "p_model"), "game_pk")
    games = t.games_v.select("game_pk", "game_date", "home_team", "away_team", F.when(g % 9 == 0, "Final").otherwise("Scheduled").alias("status"),
                             F.when(g % 13 == 0, "TBD").otherwise("A").alias("home_sp"), F.lit("B").alias("away_sp"), (g % 2 == 0).alias("home_lineup"), (g % 3 == 0).alias("away_lineup"))
    games = games.withColumn("start_ts", c("game_date").cast("timestamp") + F.expr("interval 23 hours"))
    return jobs.alert_stream(quotes, games, rules(t), 1000.0, policy="tuned", gate=gate)


@query("alert_stream", "select game_pk, alert_type, side, odds, stake_cents, lineup_status from alerts", _ACTX)
def alert_stream(t):
    out = run.drain(_alerts(t).select("game_pk", "alert_type", "side", "odds", cents("stake").alias("stake_cents"), "lineup_status"), scratch(t, "alerts"))
    return out.drop("_batch")


@query("alert_dedupe", "select distinct game_date, alert_type, home_team, away_team from alerts", _ACTX)
def alert_dedupe(t):
    path = scratch(t, "dedupe")
    table = VersionedTable(t.spark, f"{path}/alerts", "month")
    alerts = _alerts(t).select(*jobs.ALERT_KEY, "ts", F.trunc("game_date", "month").alias("month"))
    jobs.alert_dedupe(alerts, table, path)
    return table.read().select(*jobs.ALERT_KEY)


@query("alert_time_gate", """
select game_pk, alert_type from (select *, hour((ts at time zone 'UTC') at time zone 'America/New_York') as h from alerts) x where h >= 10 and h < 23 and start_ts - ts >= interval 90 minutes""", _ACTX)
def alert_time_gate(t):
    out = run.drain(_alerts(t, {"least_minutes": 90}).select("game_pk", "alert_type"), scratch(t, "gate"))
    return out.drop("_batch")


@query("streak_replay", """
select team, cast(case when s > 0 then n else -n end as bigint) as streak from (select *, row_number() over (partition by team, isl order by game_date, game_pk) as n from (
  select *, sum(chg) over (partition by team order by game_date, game_pk rows unbounded preceding) as isl from (
    select *, case when s = lag(s) over (partition by team order by game_date, game_pk) then 0 else 1 end as chg from (select game_pk, team, game_date, case when run_diff > 0 then 1 else -1 end as s from team_games_v) a) b) c) d
qualify row_number() over (partition by team order by game_date desc, game_pk desc) = 1""")
def streak_replay(t):
    """All results of the stream, in whatever order their files come."""
    path = scratch(t, "streaks")
    months = run.drain(jobs.month_runs(_team_results(t)), path, "update")
    return jobs.streaks_of(run.latest_per_key(months, ["team", "month"]))


@query("season_pct_replay", """
select team, season, count(*) as games, case when count(*) >= 10 then avg(case when run_diff > 0 then 1 else 0 end) end as season_win_pct from team_games_v group by 1, 2""")
def season_pct_replay(t):
    """Totals up to June from a snapshot, the rest of each season from the stream."""
    late = F.month("game_date") > 6
    snap = jobs.season_pct(t.team_games_v.filter(~late))
    out = run.drain(jobs.season_pct(_team_results(t).filter(late)), scratch(t, "pct"), "update")
    return jobs.with_snapshot_pct(run.latest_per_key(out, ["team", "season"]), snap)


@query("pending_settlement", """
select game_pk, won, case when won is null then null else cast(case when won then round(s * cast(net as decimal(18,6)), 2) else -s end * 100 as bigint) end as pnl_cents
from (select k.game_pk, k.net, case when k.game_pk % 4 <> 0 then k.won end as won, cast((100 + k.game_pk % 900) / 100.0 as decimal(18,2)) as s from cand k) x""", {"cand": CAND})
def pending_settlement(t):
    picks = d.choose_side(t.market_v).select("game_pk", "side", "odds")
    at = c("o_orderdate").cast("timestamp")

    def bets_of(orders):
        return orders.select(c("o_orderkey").alias("game_pk"), at.alias("bet_ts"), ((100 + c("o_orderkey") % 900) / 100).cast("decimal(18,2)").alias("stake")).join(picks, "game_pk")

    def finals_of(results):
        # finals of every seventh game come days later than the stream waits for
        wait = F.when(c("game_pk") % 7 == 0, F.expr("interval 5 days")).otherwise(F.expr("interval 3 hours"))
        return results.filter("game_pk % 4 <> 0").select("game_pk", (c("ts") + wait).alias("final_ts"), c("home_runs").alias("home_score"), c("away_runs").alias("away_score"))

    done = run.drain(jobs.settle_bets(bets_of(_stream(t, "orders")), finals_of(_results(t))).select("game_pk", "won", "pnl"), scratch(t, "settle")).drop("_batch")
    late = jobs.settle_late(bets_of(t.orders), finals_of(_result_rows(t.orders)), done).select("game_pk", "won", "pnl")
    return picks.select("game_pk").join(done.union(late), "game_pk", "left").select("game_pk", "won", cents("pnl").alias("pnl_cents"))


@query("late_correction", """
select game_pk, game_date, case when game_pk % 5 = 0 and game_date >= (select max(game_date) from games_v) - 21 then home_runs + 1 else home_runs end as home_runs from games_v""")
def late_correction(t):
    path = scratch(t, "late")
    table = VersionedTable(t.spark, f"{path}/games", "month")
    month = F.trunc("game_date", "month").alias("month")
    table.replace(t.games_v.select("game_pk", "game_date", "home_runs", month))
    newest = str(t.games_v.agg(F.max("game_date")).first()[0])
    fixes = _results(t).filter("game_pk % 5 = 0").select("game_pk", "game_date", (c("home_runs") + 1).alias("home_runs"), month)
    run.each_batch(fixes, path, lambda batch, n: jobs.apply_corrections(table, batch, ["game_pk"], "game_date", newest))
    return table.read().drop("month")


@query("snapshot_asof_stream", """
select g.game_pk, g.team, case when l.live_date is not null and g.game_date - l.live_date <= 14 then l.il_count else m.il_count end as il_count,
 case when l.live_date is not null and g.game_date - l.live_date <= 14 then 'live' when m.snap_date is not null then 'monthly' else 'none' end as source
from team_games_v g asof left join (select team, snap_date + 9 as live_date, il_count + 100 as il_count from snapshots_v where month(snap_date) <> 7) l on l.team = g.team and l.live_date <= g.game_date
 asof left join snapshots_v m on m.team = g.team and m.snap_date <= g.game_date""")
def snapshot_asof_stream(t):
    live = t.snapshots_v.filter("month(snap_date) <> 7").select("team", F.date_add("snap_date", 9).alias("live_date"), (c("il_count") + 100).alias("il_count"))
    ask = lambda batch, n: jobs.fresh_or_monthly(batch, live, t.snapshots_v, "il_count")
    out = run.drain(_team_results(t).select("game_pk", "game_date", "team"), scratch(t, "asof"), prepare=ask)
    return out.select("game_pk", "team", "il_count", "source")
