"""Scans, flatteners, sinks and incremental planners."""

import uuid

from pyspark.sql import functions as F, types as T

from fungo.catalog import query
from fungo.catalog.decisions import CAND, DECIDED, RULES_SQL, rules
from fungo.functions import odds, teams
from fungo.operators import decision as d, ordered as o
from fungo.session import checkpoint_root
from fungo.sources import planners as pl, readers as r, sinks as s
from fungo.sources.versions import VersionedTable

c = F.col


def scratch(t, name):
    """A new folder for a written table, in the shared folder of the session."""
    return f"{checkpoint_root(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


# --- scans

_LOG = T.StructType().add("game_pk", "long").add("game_date", "date").add("home", "string").add("runs", "double")


@query("csv_scan_typed", "select game_pk, game_date, 'T' || home_team as home, case when game_pk % 3 <> 0 and game_pk % 10 <> 4 then cast(home_runs as double) end as runs from games_v")
def csv_scan_typed(t):
    path = scratch(t, "csv")
    runs = F.when(c("game_pk") % 10 == 4, "n/a").when(c("game_pk") % 3 != 0, c("home_runs").cast("string"))
    t.games_v.select("game_pk", "game_date", F.concat(F.lit("T"), c("home_team").cast("string")).alias("home"), runs.alias("runs")).write.csv(path, header=True)
    return r.csv_scan_typed(t.spark, path, _LOG)


@query("table_scan_or_fallback", "select game_pk, home_team, cast(null as double) as humidity_pct from games_v")
def table_scan_or_fallback(t):
    path = scratch(t, "fallback")
    schema = T.StructType().add("game_pk", "long").add("home_team", "integer").add("humidity_pct", "double")
    t.games_v.select("game_pk", "home_team", F.lit(None).cast("double").alias("humidity_pct")).write.csv(path, header=True)
    return r.table_scan_or_fallback(t.spark, "no_such_table", path, schema)


@query("positional_log_scan", """
select game_pk, game_date, cast(year(game_date) as int) as year, case when home_team = 1 then 'CHC' else 'T' || home_team end as home_team, case when away_team = 1 then 'CHC' else 'T' || away_team end as away_team,
 'p' || game_pk % 50 as home_sp_id, 'Doe, J' || game_pk % 50 as home_sp_name, 'q' || game_pk % 40 as away_sp_id, 'Roe' as away_sp_name from games_v where game_pk % 9 <> 0""")
def positional_log_scan(t):
    code = lambda x: F.when(c(x) == 1, "CHN").otherwise(F.concat(F.lit("T"), c(x).cast("string")))
    q = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    blank = lambda n: F.lit("," * n)
    num = lambda k: (c("game_pk") % k).cast("string")
    head = [q(F.date_format("game_date", "yyyyMMdd")), blank(3), q(code("away_team")), blank(3), q(code("home_team"))]
    tail = [blank(95), q(F.concat(F.lit("q"), num(40))), blank(1), q(F.lit("Roe")), blank(1), q(F.concat(F.lit("p"), num(50))), blank(1),
            q(F.concat(F.lit("Doe, J"), num(50))), blank(56)]
    line = F.concat(*head, F.when(c("game_pk") % 9 != 0, F.concat(*tail)).otherwise(F.lit(",x")))
    return r.positional_log_scan(t.games_v.select("game_pk", line.alias("value")))


_EV = ["S8", "D7/L.1-H", "HR/F78", "HR.1-H;2-H", "K", "63", "64(1)3/GDP/G6", "W.3-H;2-3;1-2", "PB.1-2", "8/F"]
_EV_RUNS, _EV_OUTS = [0, 1, 1, 3, 0, 0, 0, 1, 0, 0], [0, 0, 0, 0, 1, 1, 2, 0, 0, 1]


def event_lines(t):
    """Play-by-play text derived from lineitem: an order is a game, a line a play."""
    li = t.lineitem.select(c("l_orderkey").alias("g"), "l_linenumber", "l_partkey", "l_suppkey")
    gid = F.concat(F.lit("NYA1999"), F.lpad(((c("g") % 12) + 1).cast("string"), 2, "0"), F.lpad(((c("g") % 28) + 1).cast("string"), 2, "0"), c("g").cast("string"))
    head = t.orders.select(c("o_orderkey").alias("g")).select(
        "g", F.posexplode(F.array(F.concat_ws(",", F.lit("id"), gid), F.lit("info,visteam,CHN"), F.lit("info,hometeam,NYA"), F.concat(F.lit("info,umphome,u"), (c("g") % 97).cast("string")),
                                  F.concat(F.lit("start,a"), (c("g") % 50).cast("string"), F.lit(',"A. Arm",0,9,1')), F.concat(F.lit("start,h"), (c("g") % 60).cast("string"), F.lit(',"H. Arm",1,9,1'))
                                  )).alias("k", "value")).select("g", c("k").cast("bigint").alias("k"), "value")
    ev = F.element_at(F.array(*[F.lit(x) for x in _EV]), ((c("l_partkey") + c("l_suppkey")) % len(_EV)).cast("int") + 1)
    play = F.concat_ws(",", F.lit("play"), c("l_linenumber").cast("string"), (c("l_suppkey") % 2).cast("string"), F.concat(F.lit("b"), c("l_partkey").cast("string")), F.lit("00"), F.lit("X"), ev)
    rank = (c("l_linenumber").cast("bigint") * 2 + c("l_suppkey") % 2) * 100000000 + c("l_partkey") * 1000 + c("l_suppkey") % 1000 + 100
    plays = li.select("g", rank.alias("k"), play.alias("value"))
    known = t.orders.select(c("o_orderkey").alias("g"))
    both = head.unionByName(plays.join(known, "g", "left_semi"))
    # 'file' spans many games; block and line give the order inside it
    return both.select((c("g") % 64).cast("string").alias("file"), c("g").alias("block"), c("k").alias("line"), "value")


@query("event_file_scan", """
select cast(o_orderkey as bigint) as block, r.record, count(*) as n from orders o join (
 select l_orderkey as g, 'play' as record from lineitem union all select o_orderkey, unnest(['id', 'info', 'info', 'info', 'start', 'start']) from orders) r on r.g = o.o_orderkey group by 1, 2""")
def event_file_scan(t):
    out = r.event_file_scan(event_lines(t)).filter(c("game_id").endswith(c("block").cast("string")))
    return out.groupBy("block", "record").agg(F.count("*").alias("n"))


@query("boxscore_json_flatten", """
select game_pk, team_side, pitcher_id, 'P' || pitcher_id as pitcher_name, row_number() over (partition by game_pk, team_side order by is_starter desc, pitcher_id) = 1 as is_starter, outs_recorded, runs_allowed
from appearances_v""")
def boxscore_json_flatten(t):
    a = t.appearances_v
    slot = F.struct((1 - c("is_starter")).alias("o"), "pitcher_id", "outs_recorded", "runs_allowed")
    person = lambda x: F.struct(F.struct(F.concat(F.lit("P"), x["pitcher_id"].cast("string")).alias("fullName")).alias("person"),
                                F.struct(F.struct(x["outs_recorded"].alias("outs"), x["runs_allowed"].alias("runs")).alias("pitching")).alias("stats"))

    def side(flag):
        rows = F.array_sort(F.collect_list(F.when(c("team_side") == flag, slot)))
        return F.struct(F.transform(rows, lambda x: x["pitcher_id"]).alias("pitchers"),
                        F.map_from_entries(F.transform(rows, lambda x: F.struct(F.concat(F.lit("ID"), x["pitcher_id"].cast("string")), person(x)))).alias("players"))

    docs = a.groupBy("game_pk").agg(F.to_json(F.struct(F.struct(side(1).alias("home"), side(0).alias("away")).alias("teams"))).alias("boxscore"))
    return r.boxscore_json_flatten(docs)


@query("play_by_play_json_flatten", """
select game, pos as play, runs, outs_after, state_after, lag(state_after, 1, '0_0') over (partition by game, top order by pos) as state_before from (
 select o_orderkey as game, n as pos, n % 2 = 0 as top, case when n % 2 = 0 then (o_orderkey + n) % 3 else (o_orderkey + n) % 2 end as runs, (o_orderkey + n) % 4 as outs_after,
  least((o_orderkey + n) % 4, 3) || '_' || case when (o_orderkey + n) % 4 = 3 then 0 else (o_orderkey + n) % 2 + 4 * ((o_orderkey // 3 + n) % 2) end as state_after
 from orders, (select unnest(range(6)) as n) k) x""")
def play_by_play_json_flatten(t):
    g = c("o_orderkey")
    away = lambda n: F.aggregate(F.sequence(F.lit(0), n), F.lit(0).cast("bigint"), lambda acc, k: acc + F.when(k % 2 == 0, (g + k) % 3).otherwise(0))
    home = lambda n: F.aggregate(F.sequence(F.lit(0), n), F.lit(0).cast("bigint"), lambda acc, k: acc + F.when(k % 2 == 1, (g + k) % 2).otherwise(0))
    pid = lambda cond: F.when(cond, F.struct(F.lit(7).cast("bigint").alias("id")))
    play = lambda n: F.struct(
        F.struct(F.lit(1).alias("inning"), (n % 2 == 0).alias("isTopInning"), F.lit(True).alias("isComplete")).alias("about"),
        F.struct(F.struct((g % 40).alias("id"), F.lit("Arm").alias("fullName")).alias("pitcher"), pid((g + n) % 2 == 1).alias("postOnFirst"),
                 pid((F.floor(g / 3) + n) % 2 == 1).alias("postOnThird")).alias("matchup"),
        F.struct(away(n).alias("awayScore"), home(n).alias("homeScore")).alias("result"), F.struct(((g + n) % 4).alias("outs")).alias("count"))
    docs = t.orders.select(g.alias("game"), F.to_json(F.struct(F.transform(F.sequence(F.lit(0), F.lit(5)), play).alias("allPlays"))).alias("plays"))
    out = r.play_by_play_json_flatten(docs, "game")
    return out.select("game", c("play").cast("bigint").alias("play"), c("runs_scored").cast("bigint").alias("runs"), c("outs_after").cast("bigint").alias("outs_after"), "state_after", "state_before")


@query("quotes_json_flatten", """
select g.game_pk, g.game_date, h.code as home_team, a.code as away_team, b.book, g.home_ml + b.k as home_ml, g.away_ml - b.k as away_ml
from market_v g join parks h on h.team = g.home_team join parks a on a.team = g.away_team, (values ('main', 0), ('other', 5)) b(book, k)""", {"parks": teams.parks_sql()})
def quotes_json_flatten(t):
    full = {code: name.title() for name, code in reversed(list(teams.NAME_ALIASES.items()))}
    name = lambda x: F.element_at(F.array(*[F.lit(full[k]) for k in teams.CODES]), c(x) + 1)
    price = lambda who, v: F.struct(name(who).alias("name"), v.alias("price"))
    market = lambda k: F.array(
        F.struct(F.lit("spreads").alias("key"), F.array(price("home_team", F.lit(-110.0))).alias("outcomes")),
        F.struct(F.lit("h2h").alias("key"), F.array(price("away_team", c("away_ml") - k), price("home_team", c("home_ml") + k)).alias("outcomes")))
    book = lambda key, k: F.struct(F.lit(key).alias("key"), market(k).alias("markets"))
    start = F.concat(F.date_format(F.date_add("game_date", 1), "yyyy-MM-dd"), F.lit("T02:10:00Z"))
    doc = F.to_json(F.struct(start.alias("commence_time"), name("home_team").alias("home_team"), name("away_team").alias("away_team"),
                             F.array(book("main", 0), book("other", 5)).alias("bookmakers")))
    return r.quotes_json_flatten(t.market_v.select("game_pk", doc.alias("quote")))


@query("schedule_json_flatten", """
select game_pk, game_date, home_team, away_team, status, case when status = 'Final' then home_runs end as home_score, case when status = 'Final' then away_runs end as away_score, '7:05 PM' as game_time
from (select g.game_pk, g.game_date, case when g.game_pk % 2 = 0 then 'KCR' else 'NYY' end as home_team, 'BOS' as away_team, home_runs, away_runs, case when game_pk % 3 = 0 then 'Scheduled' else 'Final' end as status from games_v g) x""")
def schedule_json_flatten(t):
    final = c("game_pk") % 3 != 0
    team = lambda code, score: F.struct(F.when(final, c(score)).alias("score"), F.struct(code.alias("abbreviation")).alias("team"))
    start = F.date_format(F.to_utc_timestamp(F.concat(c("game_date").cast("string"), F.lit(" 19:05:00")).cast("timestamp"), "America/New_York"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    game = F.struct(c("game_pk").alias("gamePk"), start.alias("gameDate"), F.struct(F.when(final, "Final").otherwise("Scheduled").alias("detailedState")).alias("status"),
                    F.struct(team(F.when(c("game_pk") % 2 == 0, "KC").otherwise("NYY"), "home_runs").alias("home"), team(F.lit("BOS"), "away_runs").alias("away")).alias("teams"))
    doc = F.to_json(F.struct(F.array(F.struct(c("game_date").cast("string").alias("date"), F.array(game).alias("games"))).alias("dates")))
    return r.schedule_json_flatten(t.games_v.select(doc.alias("schedule"))).drop("start_eastern")


@query("hourly_arrays_flatten", """
select game_pk, home_team, game_date as date, (game_pk % 30 + 19)::double as temp_f, (game_pk % 7 * 19)::double as wind_speed_mph from games_v""")
def hourly_arrays_flatten(t):
    hours = F.sequence(F.lit(0), F.lit(23))
    df = t.games_v.select(
        "game_pk", "home_team", F.transform(hours, lambda h: F.concat(c("game_date").cast("string"), F.lit("T"), F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))).alias("time"),
        F.transform(hours, lambda h: (c("game_pk") % 30 + h).cast("double")).alias("temp_f"), F.transform(hours, lambda h: (c("game_pk") % 7 * h).cast("double")).alias("wind_speed_mph"))
    return r.hourly_arrays_flatten(df, "time", ["temp_f", "wind_speed_mph"])


@query("json_map_scan", "select event_id, 'k' as key, cast(json_extract(props, '$.k') as bigint) as value from events")
def json_map_scan(t):
    return r.json_map_scan(t.events.select("event_id", "props"), "props", "bigint")


# --- sinks, read back

@query("report_sink", "select season, count(*) as games, cast(sum(home_win) as bigint) as home_wins from games_v group by season")
def report_sink(t):
    path = scratch(t, "report")
    s.report_sink(t.games_v.groupBy("season").agg(F.count("*").alias("games"), F.sum("home_win").alias("home_wins")), path)
    return t.spark.read.schema("season int, games bigint, home_wins bigint").csv(path, header=True)


@query("table_replace", "select game_pk, home_runs + 1 as home_runs from games_v where game_pk % 2 = 0")
def table_replace(t):
    path = scratch(t, "replace")
    s.replace_table(t.games_v.select("game_pk", "home_runs"), path)
    half = t.spark.read.parquet(path).filter("game_pk % 2 = 0").withColumn("home_runs", c("home_runs") + 1)
    s.replace_table(half, path, reads_target=True)
    return t.spark.read.parquet(path)


@query("table_upsert", "select game_pk, case when game_pk % 3 = 0 then home_runs + 100 else home_runs end as home_runs from games_v where game_pk % 3 = 0 or game_pk % 5 <> 0")
def table_upsert(t):
    table = VersionedTable(t.spark, scratch(t, "upsert"), "season")
    g = t.games_v.select("game_pk", "season", "home_runs")
    table.upsert(g.filter("game_pk % 5 <> 0"), ["game_pk"])
    table.upsert(g.filter("game_pk % 3 = 0").withColumn("home_runs", c("home_runs") + 100), ["game_pk"])
    return table.read().drop("season")


@query("append_log", "select season, count(*) as n from games_v group by season")
def append_log(t):
    path = scratch(t, "log")
    s.append_log(t.games_v.filter("season <= 1997").select("game_pk", "season"), path)
    s.append_log(t.games_v.filter("season > 1997").select("game_pk", "season"), path)
    return t.spark.read.parquet(path).groupBy("season").agg(F.count("*").alias("n"))


@query("policy_io", "select game_pk, should_bet, policy_reason from decided", {"cand": CAND, "rules": RULES_SQL, "decided": DECIDED})
def policy_io(t):
    path = scratch(t, "policy")
    s.save_policy(rules(t), "tuned", path)
    out = d.apply_policy(d.choose_side(t.market_v), s.load_policy(t.spark, path), policy="tuned")
    return out.select("game_pk", "should_bet", "policy_reason")


@query("registry_append", """
select 'm' || (season % 4) as model_id, max(season) as last_season, count(*) filter (season = m) as rows from (select season, max(season) over (partition by season % 4) as m from games_v) x group by 1""")
def registry_append(t):
    path = scratch(t, "registry")
    runs = t.games_v.groupBy("season").agg(F.count("*").alias("rows")).select(
        F.concat(F.lit("m"), (c("season") % 4).cast("string")).alias("model_id"), c("season").alias("last_season"), "rows")
    s.registry_append(t.spark, path, runs.filter("last_season <= 1998"), order=["last_season"])
    return s.registry_append(t.spark, path, runs.filter("last_season > 1998"), order=["last_season"]).read().drop("_all")


_PRICED = "select game_pk, case when game_pk % 11 = 0 then 40.0::double when game_pk % 13 = 0 then null else home_ml end as home_ml, case when game_pk % 17 = 0 then 900.0::double when game_pk % 19 = 0 then -40000.0::double else away_ml end as away_ml from odds_v"
_PRICE_REASON = """case when home_ml is null or away_ml is null then 'price missing' when abs(home_ml) < 100 or abs(away_ml) < 100 then 'no such price'
 when h + a < 1 then 'sum of probabilities below 1' when h + a > 1.25 then 'sum of probabilities above 1.25' end"""


@query("price_quarantine", f"""
select coalesce(reason, 'good') as state, count(*) as rows, cast(sum(game_pk) as bigint) as keys from (select *, {_PRICE_REASON} as reason from (
 select *, case when home_ml > 0 then 100 / (home_ml + 100) else abs(home_ml) / (abs(home_ml) + 100) end as h, case when away_ml > 0 then 100 / (away_ml + 100) else abs(away_ml) / (abs(away_ml) + 100) end as a from ({_PRICED}) p) q) r group by 1""")
def price_quarantine(t):
    """Impossible prices are kept apart with their reason, in the pass that writes the good ones."""
    path, g = scratch(t, "prices"), c("game_pk")
    rows = t.odds_v.select("game_pk", F.when(g % 11 == 0, 40.0).when(g % 13 == 0, None).otherwise(c("home_ml")).alias("home_ml"),
                           F.when(g % 17 == 0, 900.0).when(g % 19 == 0, -40000.0).otherwise(c("away_ml")).alias("away_ml"))
    vig = odds.overround(c("home_ml"), c("away_ml"))
    s.write_checked(rows, path, {"price missing": c("home_ml").isNull() | c("away_ml").isNull(), "no such price": (F.abs("home_ml") < 100) | (F.abs("away_ml") < 100),
                                 "sum of probabilities below 1": vig < 1, "sum of probabilities above 1.25": vig > 1.25})
    kept = s.read_checked(t.spark, path).select(F.lit("good").alias("state"), "game_pk")
    return kept.union(s.read_checked(t.spark, path, False).select("reason", "game_pk")).groupBy("state").agg(F.count("*").alias("rows"), F.sum("game_pk").alias("keys"))


# --- planners

@query("watermark_by_year", "select unnest(range(cast((select max(season) from games_v where season < 1999) as int) + 1, 2003))::int as year")
def watermark_by_year(t):
    return pl.watermark_by_year(t.games_v.filter("season < 1999").withColumnRenamed("season", "year"), "year", 1995, 2002)


@query("missing_dates", """
select cast(d as date) as game_date from (select unnest(generate_series(timestamp '1995-01-01', timestamp '2001-12-31', interval 1 day)) as d) x where cast(d as date) not in (select game_date from games_v where game_pk % 5 = 0)""")
def missing_dates(t):
    return pl.missing_dates(t.games_v.filter("game_pk % 5 = 0"), "game_date", "1995-01-01", "2001-12-31")


@query("missing_snapshots", """
select make_date(y, m, 1) as snap_date from (select unnest(range(1993, 2004)) as y) a, (select unnest(range(4, 11)) as m) b where make_date(y, m, 1) <= date '2003-07-15' and make_date(y, m, 1) not in (select snap_date from snapshots_v where month(snap_date) <> 6)""")
def missing_snapshots(t):
    return pl.missing_snapshots(t.snapshots_v.filter("month(snap_date) <> 6"), "snap_date", 1993, 2003, "2003-07-15")


@query("missing_entities", "select distinct l_partkey from lineitem where l_partkey not in (select p_partkey from part where p_size > 10)")
def missing_entities(t):
    return pl.missing_entities(t.lineitem, t.part.filter("p_size > 10").select(c("p_partkey").alias("l_partkey")), ["l_partkey"])


@query("refresh_current_partition", "select season as year, count(*) as n, cast(sum(case when season = 2001 then home_runs + 1 else home_runs end) as bigint) as runs from games_v group by season")
def refresh_current_partition(t):
    path = scratch(t, "parts")
    g = t.games_v.select("game_pk", "home_runs", c("season").alias("year"))
    s.refresh_partition(g, path)
    s.refresh_partition(g.filter("year = 2001").withColumn("home_runs", c("home_runs") + 1), path)
    return t.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("home_runs").alias("runs"))


@query("tail_refresh", "select home_team, max(game_date) + 1 as start, date '2001-07-20' as \"end\" from games_v group by 1 having max(game_date) + 1 <= date '2001-07-20'")
def tail_refresh(t):
    return pl.tail_refresh(t.games_v, ["home_team"], "game_date", "2001-07-20")


@query("cache_completeness", """
select e.game_date, e.n as expected, coalesce(k.n, 0) as cached_rows, coalesce(k.n, 0) >= e.n as complete from (select game_date, count(*) as n from games_v group by 1) e
left join (select game_date, count(*) as n from odds_v o join games_v g on g.game_pk = o.game_pk where o.game_pk % 6 <> 0 group by 1) k on k.game_date = e.game_date""")
def cache_completeness(t):
    cached = t.market_v.filter("game_pk % 6 <> 0")
    return pl.cache_completeness(cached, t.games_v.groupBy("game_date").agg(F.count("*").alias("expected")), "game_date")


@query("replace_by_fetched_keys", """
select game_pk, pitcher_id, outs_recorded from appearances_v where game_pk not in (select game_pk from appearances_v where game_pk % 7 = 0 and is_starter = 1)
union all select game_pk, pitcher_id, outs_recorded + 1 from appearances_v where game_pk % 7 = 0 and is_starter = 1""")
def replace_by_fetched_keys(t):
    base = t.appearances_v.select("game_pk", "pitcher_id", "outs_recorded", "is_starter")
    fetched = base.filter("game_pk % 7 = 0 and is_starter = 1").withColumn("outs_recorded", c("outs_recorded") + 1)
    return pl.replace_by_fetched_keys(base, fetched, ["game_pk"]).select("game_pk", "pitcher_id", "outs_recorded")
