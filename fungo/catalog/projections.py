"""Projections, filters, sorts, top-k, set operations and reshaping."""

from pyspark.sql import functions as F, types as T

from fungo.catalog import query
from fungo.catalog.decisions import CAND, _slate, _SLATE, candidates
from fungo.functions import geo, labels, teams
from fungo.operators import ordered as o, project as p
from fungo.plans import defaults as d

c = F.col

_WL = ["W", "L", "W-wo", "L (susp)", "PPD", "W &X"]


def _page(t):
    """A schedule page in the shape of the source: text dates, codes, both venues."""
    g = t.games_v
    wl = F.element_at(F.array(*[F.lit(x) for x in _WL]), (c("game_pk") % 6).cast("int") + 1)
    day = F.concat(F.date_format("game_date", "EEEE, MMM d"), F.when(c("game_pk") % 4 == 0, " (1)").otherwise(""))
    return g.select("game_pk", day.alias("Date"), c("season").alias("year"), teams.code_of(c("home_team")).alias("team"),
                    teams.code_of(c("away_team")).alias("Opp"), c("home_runs").alias("R"), c("away_runs").alias("RA"), wl.alias("W/L"),
                    F.when(c("game_pk") % 5 == 0, "@").otherwise("Home").alias("Home_Away"))


@query("clean_game_logs", """
select game_date, season as year, h.code as home_team, a.code as away_team, home_runs, away_runs, case when game_pk % 6 in (0, 2, 5) then 1 else 0 end as home_win
from games_v g join parks h on h.team = g.home_team join parks a on a.team = g.away_team where game_pk % 5 <> 0 and game_pk % 6 not in (3, 4)""", {"parks": teams.parks_sql()})
def clean_game_logs(t):
    return p.clean_game_logs(_page(t))


@query("coerce_numeric", """
select game_pk, case when game_pk % 4 < 2 then cast(home_runs as double) end as value from games_v""")
def coerce_numeric(t):
    raw = (F.when(c("game_pk") % 4 == 0, c("home_runs").cast("string")).when(c("game_pk") % 4 == 1, F.concat(F.lit(" "), c("home_runs").cast("string"), F.lit(".0")))
           .when(c("game_pk") % 4 == 2, "-.--").otherwise("NaN"))
    return t.games_v.select("game_pk", p.coerce_numeric(raw).alias("value"))


@query("status_filter", "select game_pk from games_v where game_pk % 5 in (0, 1) and game_pk % 7 <> 0")
def status_filter(t):
    st = F.element_at(F.array(*[F.lit(x) for x in ["Final", "Complete", "In Progress", "Final?", "Postponed"]]), (c("game_pk") % 5).cast("int") + 1)
    df = t.games_v.withColumns({"status": F.when(st != "Final?", st), "home_score": F.when(c("game_pk") % 7 != 0, c("home_runs")), "away_score": c("away_runs")})
    return p.status_filter(df, "status", ["home_score", "away_score"]).select("game_pk")


@query("season_slice", "select game_pk, season from games_v where season in (1996, 1998, 1999) and game_date <= date '1999-06-30'")
def season_slice(t):
    return p.season_slice(t.games_v, "season", [1996, 1998, 1999], day="game_date", until="1999-06-30").select("game_pk", "season")


_IMP = "case when {0} > 0 then 100 / ({0} + 100) else abs({0}) / (abs({0}) + 100) end"


@query("vig_bounds_filter", f"""
select game_pk from (select game_pk, season, {_IMP.format('(home_ml * k)')} + {_IMP.format('away_ml')} as s from (select *, 1 + (game_pk % 5) / 20.0::double as k from market_v) y) x
where s between case when season + 24 < 2022 then 1.01::double else 1.03::double end and case when season + 24 < 2022 then 1.05::double else 1.13::double end""")
def vig_bounds_filter(t):
    df = t.market_v.withColumn("home_ml", c("home_ml") * (1 + (c("game_pk") % 5) / 20.0))
    return p.vig_bounds_filter(df, "home_ml", "away_ml", c("season") + 24).select("game_pk")


@query("valid_moneyline_filter", "select game_pk from odds_v where abs(home_ml - game_pk % 40) >= 100 and abs(away_ml) >= 100")
def valid_moneyline_filter(t):
    df = t.odds_v.withColumn("home_ml", c("home_ml") - c("game_pk") % 40)
    return p.valid_moneyline_filter(df, "home_ml", "away_ml").select("game_pk")


@query("bad_quote_fallback", """
select game_pk, case when abs(m) < 100 and game_pk % 3 <> 0 then home_ml else m end as price from (select game_pk, home_ml, (home_ml + away_ml) / 2 as m from odds_v) x""")
def bad_quote_fallback(t):
    primary = F.when(c("game_pk") % 3 != 0, c("home_ml"))
    return t.odds_v.select("game_pk", p.bad_quote_fallback((c("home_ml") + c("away_ml")) / 2, primary).alias("price"))


_HOLES = ["h2h_home_win_rate", "home_sp_era_adj", "away_sp_era_adj", "temp_f", "home_barrel_pct", "away_barrel_pct", "home_momentum", "sp_era_adj_diff", "barrel_pct_diff", "other"]


def _holes_sql():
    return ("select game_pk, " + ", ".join(
        f"case when game_pk % {i + 3} <> 0 then cast((game_pk % {i + 11}) / 8.0::double as double) end as {n}" for i, n in enumerate(_HOLES)) + " from games_v")


def _holes(t):
    return t.games_v.select("game_pk", *[F.when(c("game_pk") % (i + 3) != 0, (c("game_pk") % (i + 11)) / 8.0).alias(n) for i, n in enumerate(_HOLES)])


_FILLS = {n: d.NEUTRAL.get(n, 0.0 if n.endswith(p.ZERO_ENDINGS) else None) for n in _HOLES}


@query("neutral_defaults", "select game_pk, " + ", ".join(n if v is None else f"coalesce({n}, {v}::double) as {n}" for n, v in _FILLS.items()) + " from holes", {"holes": _holes_sql()})
def neutral_defaults(t):
    return p.fill_neutral(_holes(t), d.NEUTRAL)


@query("recompute_diffs", """
select game_pk, coalesce(away_sp_era_adj - home_sp_era_adj, 0.0::double) as sp_era_adj_diff, coalesce(home_barrel_pct - away_barrel_pct, 0.0::double) as barrel_pct_diff from holes""", {"holes": _holes_sql()})
def recompute_diffs(t):
    return p.recompute_diffs(_holes(t), d.DIFF_PAIRS).select("game_pk", "sp_era_adj_diff", "barrel_pct_diff")


@query("diff_features", "select game_pk, home_sp_era_adj - away_sp_era_adj as home_edge, away_sp_era_adj - home_sp_era_adj as away_edge, home_barrel_pct - away_barrel_pct as barrels from holes", {"holes": _holes_sql()})
def diff_features(t):
    return _holes(t).select("game_pk", *[(c(l) - c(r)).alias(n) for n, (l, r) in {
        "home_edge": ("home_sp_era_adj", "away_sp_era_adj"), "away_edge": ("away_sp_era_adj", "home_sp_era_adj"), "barrels": ("home_barrel_pct", "away_barrel_pct")}.items()])


@query("calendar_features", """
select game_pk, month(game_date)::double as game_month, dayofyear(game_date)::double as game_day_of_year, (month(game_date) in (3, 4))::int::double as is_early_season, 0.0::double as post_2023_rules from games_v""")
def calendar_features(t):
    return p.calendar_features(t.games_v, "game_date").select("game_pk", "game_month", "game_day_of_year", "is_early_season", "post_2023_rules")


@query("ensure_columns", "select game_pk, cast(home_team as bigint) as home_team, cast(null as double) as humidity_pct, home_runs from games_v")
def ensure_columns(t):
    schema = T.StructType().add("game_pk", "long").add("home_team", "long").add("humidity_pct", "double")
    return p.ensure_columns(t.games_v.select("game_pk", "home_team", "home_runs"), schema)


@query("first_present", "select game_pk, coalesce(case when game_pk % 2 = 0 then p_model end, case when game_pk % 3 = 0 then p_market end) as close_prob from odds_v")
def first_present(t):
    df = t.odds_v.withColumns({"closing_prob": F.when(c("game_pk") % 2 == 0, c("p_model")), "close_prob": F.when(c("game_pk") % 3 == 0, c("p_market"))})
    return df.select("game_pk", p.first_present(df, ["absent", "closing_prob", "close_prob"]).alias("close_prob"))


@query("optional_column_projection", "select game_pk, home_ml, away_ml from odds_v")
def optional_column_projection(t):
    return p.optional_columns(t.odds_v, ["game_pk", "home_ml", "away_ml", "open_home_ml", "close_home_ml"])


@query("prefer_blended", "select game_pk, case when game_pk % 3 = 0 then p_model else p_market end as ops from odds_v")
def prefer_blended(t):
    return t.odds_v.select("game_pk", F.coalesce(F.when(c("game_pk") % 3 == 0, c("p_model")), "p_market").alias("ops"))


@query("select_by_hand", "select game_pk, case when game_pk % 3 = 0 then p_model when game_pk % 3 = 1 then p_market end as ops from odds_v")
def select_by_hand(t):
    hand = F.when(c("game_pk") % 3 == 0, "L").when(c("game_pk") % 3 == 1, "R")
    return t.odds_v.select("game_pk", p.select_by_hand(hand, c("p_model"), c("p_market")).alias("ops"))


@query("dome_override", f"select game_pk, case when home_team = {teams.CODES.index('TBR')} then 72 else game_pk % 60 + 40 end::double as temp_f, case when home_team = {teams.CODES.index('TBR')} then 0 else game_pk % 20 end::double as wind_speed_mph from games_v")
def dome_override(t):
    from fungo.plans.environment import dome_override
    df = t.games_v.select("game_pk", teams.code_of(c("home_team")).alias("home_code"), (c("game_pk") % 60 + 40).cast("double").alias("temp_f"), (c("game_pk") % 20).cast("double").alias("wind_speed_mph"))
    return dome_override(df, "home_code").select("game_pk", "temp_f", "wind_speed_mph")


@query("drop_incomplete", "select game_pk from holes where temp_f is not null and home_barrel_pct is not null", {"holes": _holes_sql()})
def drop_incomplete(t):
    return p.drop_incomplete(_holes(t), ["temp_f", "home_barrel_pct"]).select("game_pk")


@query("dedupe_keep", """
select l_orderkey, l_partkey, l_suppkey, l_quantity from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber desc, l_partkey desc, l_suppkey desc) = 1""")
def dedupe_keep(t):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_linenumber")
    return p.dedupe_keep(df, ["l_orderkey"], ["l_quantity", "l_linenumber", "l_partkey", "l_suppkey"], "last").drop("l_linenumber")


_CODES = ["IL", "RM", "TR", "XX"]


def _tx(t):
    return t.events.select("event_id", F.to_date("ts").alias("date"), (c("user_id") % 30).cast("int").alias("team"),
                           F.element_at(F.array(*[F.lit(x) for x in _CODES]), (c("event_id") % 4).cast("int") + 1).alias("type_code"))


@query("notable_transactions", """
select event_id from events where cast(ts as date) >= date '2024-01-20' and event_id % 4 in (0, 2) and user_id % 30 in (select team from snapshots_v where il_count > 12)""")
def notable_transactions(t):
    busy = t.snapshots_v.filter("il_count > 12").select("team")
    return p.notable_transactions(_tx(t), "2024-01-20", ["IL", "TR"], busy).select("event_id")


@query("period_filter", """
select '7d' as period, game_pk from games_v where game_date > date '1998-05-13' and game_date <= date '1998-05-20'
union all select 'month', game_pk from games_v where date_trunc('month', game_date) = date '1998-05-01'
union all select 'custom', game_pk from games_v where game_date between date '1997-01-01' and date '1997-02-15'""")
def period_filter(t):
    def one(name, **kw):
        return p.period_filter(t.games_v, "game_date", name, "1998-05-20", **kw).select(F.lit(name).alias("period"), "game_pk")
    return one("7d").unionByName(one("month")).unionByName(one("custom", start="1997-01-01", end="1997-02-15"))


# --- sort, limit, top-k

_TEAM_FORM = "select team, cast(sum(run_diff) as bigint) as rd, count(*) as games from team_games_v group by team"


def _form(t):
    return t.team_games_v.groupBy("team").agg(F.sum("run_diff").alias("rd"), F.count("*").alias("games"))


@query("multi_key_sort", f"select team, rd, games from ({_TEAM_FORM}) x order by games desc, rd asc, team")
def multi_key_sort(t):
    return _form(t).orderBy(F.desc("games"), F.asc("rd"), "team")


@query("top_bottom_n", f"""
(select team, rd, games, 'hot' as list from ({_TEAM_FORM}) x order by rd desc, team limit 5) union all (select team, rd, games, 'cold' from ({_TEAM_FORM}) x order by rd, team limit 5)""")
def top_bottom_n(t):
    return p.top_bottom_n(_form(t), "rd", "team", 5)


@query("recent_n", "select game_pk, game_date from games_v order by game_date desc, game_pk desc limit 50")
def recent_n(t):
    return t.games_v.select("game_pk", "game_date").orderBy(F.desc("game_date"), F.desc("game_pk")).limit(50)


@query("quota_topk_per_group", "select game_pk, game_date, quota, selected from (" + _SLATE.replace("select game_pk, quota,", "select game_pk, game_date, quota,") + ") w where selected", {"cand": CAND})
def quota_topk_per_group(t):
    return _slate(t).filter("selected").select("game_pk", "game_date", "quota", "selected")


@query("screen_then_confirm", """
select c_custkey as config, n, s from (select c_custkey from customer join orders on o_custkey = c_custkey and o_orderstatus = 'F' group by 1 order by sum(cast(round(o_totalprice * 100) as bigint)) desc, c_custkey limit 8) k
join (select o_custkey, count(*) as n, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as s from orders group by 1) x on x.o_custkey = k.c_custkey""")
def screen_then_confirm(t):
    cents = F.round(c("o_totalprice") * 100).cast("bigint")
    screened = t.orders.filter("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("config")).agg(F.sum(cents).alias("score")).orderBy(F.desc("score"), "config").limit(8)
    stage2 = t.orders.withColumnRenamed("o_custkey", "config").join(screened, "config", "left_semi")
    return stage2.groupBy("config").agg(F.count("*").alias("n"), F.sum(cents).alias("s"))


# --- set operations

@query("symmetric_union", "select game_pk, game_date, season, team, opponent, venue, cast(rf as bigint) as rf, cast(ra as bigint) as ra, cast(run_diff as bigint) as run_diff from team_games_v")
def symmetric_union(t):
    side = lambda us, them: {"team": f"{us}_team", "opponent": f"{them}_team", "rf": c(f"{us}_runs").cast("bigint"), "ra": c(f"{them}_runs").cast("bigint"),
                             "run_diff": (c(f"{us}_runs") - c(f"{them}_runs")).cast("bigint")}
    return p.symmetric(t.games_v, ["game_pk", "game_date", "season"], side("home", "away"), side("away", "home"))


@query("source_union", """
select game_pk, case when game_pk % 3 = 0 then away_runs else home_runs end as runs, case when game_pk % 3 = 0 then 2 else 1 end as source from games_v where game_pk % 3 = 0 or game_pk % 5 <> 0""")
def source_union(t):
    hist = t.games_v.filter("game_pk % 5 <> 0").select("game_pk", c("home_runs").alias("R"), F.lit(1).alias("source"))
    live = t.games_v.filter("game_pk % 3 = 0").select(c("game_pk").alias("gamePk"), c("away_runs").alias("runs"), F.lit(2).alias("source"))
    return p.source_union([(hist, {"R": "runs"}), (live, {"gamePk": "game_pk"})], ["game_pk"], ["source"])


@query("key_difference", "select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def key_difference(t):
    seen = t.customer.filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("o_custkey"))
    return p.key_difference(t.orders.select("o_custkey").distinct(), seen, ["o_custkey"])


@query("key_union", "select home_team as team from games_v union select away_team from games_v")
def key_union(t):
    return p.key_union(t.games_v, ["home_team", "away_team"], "team")


# --- reshape

def _probs(t):
    return t.market_v.select("game_pk", F.inline(F.array(*[F.struct(F.lit(n).alias("base_model"), e.alias("home_prob")) for n, e in (
        ("a", c("p_model")), ("b", c("p_market")), ("c", (c("p_model") + c("p_market")) / 2))])))


@query("pivot_first", "select game_pk, p_model as a, p_market as b, (p_model + p_market) / 2 as c from odds_v")
def pivot_first(t):
    return p.pivot_first(_probs(t), ["game_pk"], "base_model", ["a", "b", "c"], "home_prob", "home_prob")


@query("unpivot_features", """
select game_pk, 'temp_f' as feature, temp_f as value from holes union all select game_pk, 'home_barrel_pct', home_barrel_pct from holes union all select game_pk, 'other', other from holes""", {"holes": _holes_sql()})
def unpivot_features(t):
    return p.unpivot_features(_holes(t), ["game_pk"], ["temp_f", "home_barrel_pct", "other"])


@query("side_orient", """
select game_pk, case when h % 2 = 0 then away_barrel_pct else home_barrel_pct end as home_barrel_pct, case when h % 2 = 0 then home_barrel_pct else away_barrel_pct end as away_barrel_pct,
 case when h % 2 = 0 then -barrel_pct_diff else barrel_pct_diff end as barrel_pct_diff, temp_f from (select *, game_pk // 3 as h from holes) x""", {"holes": _holes_sql()})
def side_orient(t):
    feats = ["home_barrel_pct", "away_barrel_pct", "barrel_pct_diff", "temp_f"]
    return p.side_orient(_holes(t), feats, F.floor(c("game_pk") / 3) % 2 == 0).select("game_pk", *feats)


@query("explode_roster", """
select r.g, cast(sum(cast(v.rate * v.w as decimal(18,8))) as double) / cast(sum(cast(v.w as decimal(18,8))) as double) as lineup_rate, count(v.rate) as known from (
 select l_orderkey as g, l_partkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as slot, year(l_shipdate) as season from lineitem) r
left join (select l_partkey, year(l_shipdate) + 1 as season, avg(cast(l_quantity as bigint)) as rate, cast(count(*) as double) as w from lineitem group by 1, 2) v on v.l_partkey = r.l_partkey and v.season = r.season
where slot <= 9 group by r.g""")
def explode_roster(t):
    from fungo.plans.batting import lineup_rates
    li = t.lineitem.withColumn("season", F.year("l_shipdate"))
    person = F.struct(c("l_partkey").alias("player"), "season")
    lineups = o.first_n_array(li.withColumnRenamed("l_orderkey", "g"), ["g"], ["l_linenumber", "l_partkey", "l_suppkey"], 9, person, "slots")
    rates = li.groupBy(c("l_partkey").alias("player"), "season").agg(F.avg(c("l_quantity").cast("bigint")).alias("rate"), F.count("*").cast("double").alias("w"))
    return lineup_rates(lineups, rates, ["g"])
