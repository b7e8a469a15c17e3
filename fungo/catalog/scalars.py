"""Scalar functions, each over a whole table."""

from pyspark.sql import functions as F

from fungo.catalog import query
from fungo.operators.ordered import first_n_array
from fungo.functions import geo, labels, names, odds, plays, teams

c = F.col


def sql_list(xs):
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"


def pick(xs, index):
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (index % len(xs)).cast("int") + 1)


def sql_map(pairs):
    return "map {" + ", ".join("'{}': '{}'".format(k.replace("'", "''"), v) for k, v in pairs.items()) + "}"


_SPELLINGS = [" cws ", "KC", "sd", "SF", "tb ", "WSH", "oak", "NYY", "lad", "XYZ"]
_TEAM_NAMES = ["Arizona Diamondbacks", " boston red sox", "ST. LOUIS CARDINALS", "Athletics", "LA Angels", "Springfield"]


@query("normalize_team", f"""
with x as (select game_pk, upper(trim({sql_list(_SPELLINGS)}[game_pk % {len(_SPELLINGS)} + 1])) as code,
  lower(trim({sql_list(_TEAM_NAMES)}[game_pk % {len(_TEAM_NAMES)} + 1])) as full_name from games_v)
select game_pk, coalesce({sql_map(teams.SCHEDULE_ALIASES)}[code], code) as team_code,
 coalesce({sql_map(teams.NAME_ALIASES)}[full_name], upper(full_name)) as named_team from x""".replace("with x as", "select * from (with x as") + ")")
def normalize_team(t):
    return t.games_v.select(
        "game_pk", teams.normalize_schedule_team(pick(_SPELLINGS, c("game_pk"))).alias("team_code"),
        teams.normalize_team_name(pick(_TEAM_NAMES, c("game_pk"))).alias("named_team"))


_CITIES, _LEAGUES = ["Chicago", "New York ", "los angeles", "Houston", "Boise"], ["MLB-AL", "MLB-NL", ""]


@query("normalize_ambiguous_city", f"""
select game_pk, case when city = 'chicago' then case when al then 'CHW' else 'CHC' end
 when city = 'new york' then case when al then 'NYY' else 'NYM' end
 when city = 'los angeles' then case when al then 'LAA' else 'LAD' end
 when city = 'houston' then 'HOU' else upper(city) end as team
from (select game_pk, lower(trim({sql_list(_CITIES)}[game_pk % 5 + 1])) as city,
  {sql_list(_LEAGUES)}[(game_pk // 7) % 3 + 1] = 'MLB-AL' as al from games_v) x""")
def normalize_ambiguous_city(t):
    league = pick(_LEAGUES, F.floor(c("game_pk") / 7))
    return t.games_v.select("game_pk", teams.normalize_ambiguous_city(pick(_CITIES, c("game_pk")), league).alias("team"))


_FIRST = ["José", "Michael", "Hyun-Jin", "ZACHARY", "André", "Nate"]
_LAST = ["Rodríguez", "O'Neil", "Peña", "Van Dyke", "Smith-Jones", "Müller"]
_SUFFIX = ["", " Jr.", " III", " Sr", " iv"]
_PERSON = """{first}[c_custkey % 6 + 1] as f, {last}[(c_custkey // 6) % 6 + 1] as l, {suffix}[(c_custkey // 36) % 5 + 1] as s""".format(
    first=sql_list(_FIRST), last=sql_list(_LAST), suffix=sql_list(_SUFFIX))


def _person(t):
    f, l, s = (pick(xs, F.floor(c("c_custkey") / d)) for xs, d in ((_FIRST, 1), (_LAST, 6), (_SUFFIX, 36)))
    return t.customer.select("c_custkey", F.when(c("c_custkey") % 2 == 0, F.concat(f, F.lit(" "), l, s))
                             .otherwise(F.concat(l, s, F.lit(",  "), f)).alias("raw_name"))


@query("normalize_person_name", f"""
select c_custkey, trim(regexp_replace(replace(lower(
   coalesce({sql_map({'michael': 'mike', 'zachary': 'zach'})}[lower(f)], strip_accents(f)) || ' ' || strip_accents(l)), '-', ' '), '\\s+', ' ', 'g')) as name_norm
from (select c_custkey, {_PERSON} from customer) x""")
def normalize_person_name(t):
    return _person(t).select("c_custkey", names.normalize_person_name(c("raw_name")).alias("name_norm"))


@query("repair_mojibake", "select doc_id, text as repaired from documents")
def repair_mojibake(t):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    latin = c("text").rlike(r"^[\x00-\xFF]*$")
    raw = F.when((c("doc_id") % 2 == 0) | ~latin, broken).otherwise(c("text"))
    return t.documents.select("doc_id", names.repair_mojibake(raw).alias("repaired"))


@query("repair_escapes", f"select c_custkey, l || s as repaired from (select c_custkey, {_PERSON} from customer) x")
def repair_escapes(t):
    l, s = pick(_LAST, F.floor(c("c_custkey") / 6)), pick(_SUFFIX, F.floor(c("c_custkey") / 36))
    chars = F.split(F.concat(l, s), "")
    escaped = F.array_join(F.transform(chars, lambda x: F.when(x.rlike(r"^[\x00-\x7F]$"), x).otherwise(
        F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-8"))), "(..)", r"\\x$1"))), "")
    return t.customer.select("c_custkey", names.repair_escapes(escaped).alias("repaired"))


@query("game_identity", """
select game_pk, strftime(game_date, '%Y%m%d') || '_' || home_team || '_' || away_team || '_' || game_number as game_id from games_v""")
def game_identity(t):
    from fungo.operators.project import game_identity
    return game_identity(t.games_v, "game_date", "home_team", "away_team", "game_number").select("game_pk", "game_id")


_MICRO = "cast(floor({} * 1000000 + 0.5) as bigint)"


def micro(x):
    """Six fixed decimals as an integer: comparable across engines."""
    return F.floor(x * 1000000 + 0.5).cast("bigint")


@query("haversine_miles", f"""
select g.game_pk, cast(floor(2 * 3958.8 * asin(sqrt(power(sin(radians(h.lat - a.lat) / 2), 2)
 + cos(radians(a.lat)) * cos(radians(h.lat)) * power(sin(radians(h.lon - a.lon) / 2), 2))) * 1000 + 0.5) as bigint) as trip_milli
from games_v g join parks h on g.home_team = h.team join parks a on g.away_team = a.team""", {"parks": teams.parks_sql()})
def haversine_miles(t):
    p = teams.parks(t.spark)
    side = lambda s: F.broadcast(p.select(c("team").alias(f"{s}_team"), c("lat").alias(f"{s}_lat"), c("lon").alias(f"{s}_lon")))
    out = t.games_v.join(side("home"), "home_team").join(side("away"), "away_team")
    miles = geo.haversine_miles(c("away_lat"), c("away_lon"), c("home_lat"), c("home_lon"))
    return out.select("game_pk", F.floor(miles * 1000 + 0.5).cast("bigint").alias("trip_milli"))


@query("wind_component", f"""
select game_pk, case when home_team = {teams.CODES.index('TBR')} then 0 else cast(floor(
 (game_pk % 25) * cos(radians(((game_pk * 37) % 360 + 180) % 360 - b[home_team + 1])) * 1000 + 0.5) as bigint) end as wind_milli
from (select game_pk, home_team, {[geo.CENTRE_BEARING[k] for k in teams.CODES]} as b from games_v) x""")
def wind_component(t):
    bearing = pick([float(geo.CENTRE_BEARING[k]) for k in teams.CODES], c("home_team"))
    dome = teams.code_of(c("home_team")).isin(*geo.DOMES)
    w = geo.wind_to_centre((c("game_pk") % 25).cast("double"), ((c("game_pk") * 37) % 360).cast("double"), bearing, dome)
    return t.games_v.select("game_pk", F.floor(w * 1000 + 0.5).cast("bigint").alias("wind_milli"))


@query("park_adjust", """
select game_pk, case when pf > 0 then era * (2.0::double / (1.0::double + pf)) else era end as era_adj
from (select game_pk, cast(home_runs as double) as era, cast(nullif(game_pk % 7, 3) as double) / 4 - 0.25::double as pf from games_v) x""")
def park_adjust(t):
    pf = F.nullif(c("game_pk") % 7, F.lit(3)).cast("double") / 4 - 0.25
    return t.games_v.select("game_pk", geo.park_adjust(c("home_runs").cast("double"), pf).alias("era_adj"))


_P = "case when {0} > 0 then 100 / ({0} + 100) else abs({0}) / (abs({0}) + 100) end"


@query("implied_prob", f"select game_pk, {_P.format('home_ml')} as home_implied, {_P.format('away_ml')} as away_implied from odds_v")
def implied_prob(t):
    return t.odds_v.select("game_pk", odds.implied_prob(c("home_ml")).alias("home_implied"),
                           odds.implied_prob(c("away_ml")).alias("away_implied"))


@query("devig", f"select game_pk, h / (h + a) as home_prob from (select game_pk, {_P.format('home_ml')} as h, {_P.format('away_ml')} as a from odds_v) x")
def devig(t):
    return t.odds_v.select("game_pk", odds.devig(c("home_ml"), c("away_ml")).alias("home_prob"))


@query("net_odds", """
select m.game_pk, n as net, case when home_win = 1 then n else -1.0::double end as flat
from (select game_pk, home_win, case when home_ml > 0 then home_ml / 100 else 100 / abs(home_ml) end as n from market_v) m""")
def net_odds(t):
    return t.market_v.select("game_pk", odds.net_odds(c("home_ml")).alias("net"),
                             odds.flat_profit(c("home_ml"), c("home_win") == 1).alias("flat"))


@query("odds_bucket", """
select game_pk, case when home_ml < -180 then '<-180' when home_ml < -140 then '-180:-140' when home_ml < -115 then '-140:-115'
 when home_ml < 100 then '-115:+100' when home_ml < 130 then '+100:+130' when home_ml < 170 then '+130:+170' else '+170+' end as bucket from odds_v""")
def odds_bucket(t):
    return t.odds_v.select("game_pk", odds.odds_bucket(c("home_ml")).alias("bucket"))


@query("season_phase", """
select game_pk, case when month(game_date) <= 4 then 'early' when month(game_date) >= 9 then 'late' else 'mid' end as phase from games_v""")
def season_phase(t):
    return t.games_v.select("game_pk", labels.season_phase(c("game_date")).alias("phase"))


@query("recency_weight", """
select game_pk, case when y >= 2023 then 3.0 when y = 2022 then 2.0 when y >= 2020 then 1.5 else 1.0 end::double as weight
from (select game_pk, season + 23 as y from games_v) x""")
def recency_weight(t):
    return t.games_v.select("game_pk", labels.recency_weight(c("season") + 23).alias("weight"))


@query("safe_diff", """
select game_pk, case when game_pk % 5 = 0 or game_pk % 7 = 0 then null else home_runs - away_runs end as diff from games_v""")
def safe_diff(t):
    left = F.when(c("game_pk") % 5 != 0, c("home_runs"))
    right = F.when(c("game_pk") % 7 != 0, c("away_runs"))
    return t.games_v.select("game_pk", (left - right).alias("diff"))


# event text, runs and outs it stands for
_EVENTS = [
    ("S8", 0, 0), ("D7/L.1-H", 1, 0), ("HR/F78", 1, 0), ("HR.1-H;2-H", 3, 0), ("HR.1-H;B-H", 2, 0), ("W.3-H;2-3;1-2", 1, 0),
    ("PB.1-2", 0, 0), ("WP.3-H", 1, 0), ("CS2(26)", 0, 1), ("PO1(13)", 0, 1), ("POCS2(1361)", 0, 1), ("PO1(E1)", 0, 0),
    ("64(1)3/GDP/G6", 0, 2), ("5(2)4(1)3/GTP", 0, 3), ("8/F", 0, 1), ("K", 0, 1), ("K+WP.B-1", 0, 1), ("63", 0, 1), ("FC6.1X2", 0, 0),
    ("E6.1-3", 0, 0), ("SB2", 0, 0), ("NP", 0, 0), ("T9.2-H;1-H", 2, 0), ("HP", 0, 0), ("BK.3-H", 1, 0), ("", 0, 0),
]


@query("classify_event", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, "
       f"{[r for _, r, _ in _EVENTS]}[(l_orderkey + l_partkey) % {len(_EVENTS)} + 1] as runs, "
       f"{[u for _, _, u in _EVENTS]}[(l_orderkey + l_partkey) % {len(_EVENTS)} + 1] as outs from lineitem")
def classify_event(t):
    ev = pick([e for e, _, _ in _EVENTS], c("l_orderkey") + c("l_partkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                             plays.runs_on_play(ev).alias("runs"), plays.outs_on_play(ev).alias("outs"))


@query("base_state_key", """
select l_orderkey, l_linenumber, l_partkey, least(l_partkey % 5, 3) || '_' || (l_partkey % 2 + 2 * (l_suppkey % 2) + 4 * (l_orderkey % 2)) as state from lineitem""")
def base_state_key(t):
    bit = lambda x: c(x) % 2 == 1
    key = plays.base_state_key((c("l_partkey") % 5).cast("int"), bit("l_partkey"), bit("l_suppkey"), bit("l_orderkey"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", key.alias("state"))


@query("split_ids", """
select g, array_to_string([x for x in list_transform(ids, lambda y: y + 0)][1:9], ',') as first_ids
from (select o_custkey as g, list(o_orderkey order by o_orderkey) as ids from orders group by 1) x""")
def split_ids(t):
    lists = first_n_array(t.orders.withColumnRenamed("o_custkey", "g"), ["g"], ["o_orderkey"], 12, "o_orderkey", "ids")
    packed = lists.select("g", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("packed"))
    return packed.select("g", F.array_join(F.transform(labels.split_ids(F.concat(F.lit(" x1 "), c("packed"))),
                                                       lambda x: x.cast("string")), ",").alias("first_ids"))


@query("sample_blend", """
select game_pk, case when cur is not null and pri is not null then cur * w + pri * (1 - w) else coalesce(cur, pri) end as blended
from (select game_pk, case when game_pk % 5 <> 0 then p_model end as cur, case when game_pk % 7 <> 0 then p_market end as pri,
  greatest(0.0::double, least(1.0::double, (game_pk % 200) / 150.0::double)) as w from odds_v) x""")
def sample_blend(t):
    cur, pri = F.when(c("game_pk") % 5 != 0, c("p_model")), F.when(c("game_pk") % 7 != 0, c("p_market"))
    return t.odds_v.select("game_pk", labels.sample_blend(cur, pri, c("game_pk") % 200).alias("blended"))


@query("capped_blend", """
select game_pk, case when a + b > 0 then (coalesce(pri, 0) * a + coalesce(cur, 0) * b) / (a + b) end as blended
from (select game_pk, cur, pri, case when pri is not null and game_pk % 500 > 0 then least(cast(game_pk % 500 as double), 200) else 0 end::double as a,
  case when cur is not null and game_pk % 90 > 0 then game_pk % 90 else 0 end::double as b
  from (select game_pk, case when game_pk % 5 <> 0 then p_model end as cur, case when game_pk % 7 <> 0 then p_market end as pri from odds_v) y) x""")
def capped_blend(t):
    cur, pri = F.when(c("game_pk") % 5 != 0, c("p_model")), F.when(c("game_pk") % 7 != 0, c("p_market"))
    return t.odds_v.select("game_pk", labels.capped_blend(pri, c("game_pk") % 500, cur, c("game_pk") % 90).alias("blended"))


@query("confidence_band", """
select game_pk, case when p >= 0.65 then 'high' when p >= 0.58 then 'medium' else 'low' end as band,
 case when m >= 0.5 then 'hot' when m <= -0.5 then 'cold' else '' end as trend,
 case when s >= 3 then '+' || s || 'W' when s <= -3 then -s || 'L' else '' end as streak
from (select game_pk, greatest(p_model, 1 - p_model) as p, (p_model - p_market) * 8 as m, game_pk % 13 - 6 as s from odds_v) x""")
def confidence_band(t):
    return t.odds_v.select(
        "game_pk", labels.confidence_band(F.greatest("p_model", 1 - c("p_model"))).alias("band"),
        labels.trend_badge((c("p_model") - c("p_market")) * 8).alias("trend"),
        labels.streak_badge(c("game_pk") % 13 - 6).alias("streak"))


@query("key_factor_rules", """
select game_pk, array_to_string(case when len(f) > 0 then f else ['model gives ' || pk || ' ' || conf_t] end, '; ') as factors
from (select game_pk, pk, (k1 // 10) || '.' || (k1 % 10) || '%' as conf_t, list_filter([
  case when not known then 'starter not confirmed' end,
  case when gap >= 0.5 then case when pk = h then 'pitching edge: ' else 'pitching concern: ' end || h
       when gap <= -0.5 then case when pk = a then 'pitching edge: ' else 'pitching concern: ' end || a end,
  case when known and edge >= 0.05 then 'market edge: ' || (k2 // 10) || '.' || (k2 % 10) || '% on ' || pk end,
  case when known and edge >= 0.05 and conf < 0.55 then 'value play, not a strong favorite: ' || pk end,
  case when known and edge <= -0.05 then 'market caution: ' || (k2 // 10) || '.' || (k2 % 10) || '% below on ' || pk end,
  case when hs >= 4 then h || ' won ' || hs || ' straight' when hs <= -4 then h || ' lost ' || -hs || ' straight' end,
  case when hm >= 0.7 then h || ' trending up' when hm <= -0.7 then h || ' cooling off' end,
  case when s2 >= 4 then a || ' won ' || s2 || ' straight' when s2 <= -4 then a || ' lost ' || -s2 || ' straight' end,
  case when am >= 0.7 then a || ' trending up' when am <= -0.7 then a || ' cooling off' end,
  case when known and pk = h and p_market < 0.5 and p_model > 0.52 then 'home underdog value: ' || h end,
  case when not roof and spd >= 8 and wind >= 7 then 'wind blowing out' when not roof and spd >= 8 and wind <= -7 then 'wind blowing in' end,
  case when not roof and temp >= 88 then 'hot weather' when not roof and temp <= 45 then 'cold weather' end], lambda x: x is not null) as f
 from (select *, cast(floor(conf * 1000 + 0.5) as bigint) as k1, cast(floor(abs(edge) * 1000 + 0.5) as bigint) as k2 from (
  select m.*, 'T' || home_team as h, 'T' || away_team as a, game_pk % 11 <> 0 as known,
   case when p_model >= 0.5 then 'T' || home_team else 'T' || away_team end as pk, greatest(p_model, 1 - p_model) as conf,
   case when p_model >= 0.5 then p_model - p_market else p_market - p_model end as edge,
   (game_pk % 9 - 4) / 4.0::double as gap, game_pk % 17 - 8 as hs, game_pk % 19 - 9 as s2,
   (game_pk % 23 - 11) / 10.0::double as hm, (game_pk % 29 - 14) / 10.0::double as am,
   game_pk % 31 - 15 as wind, game_pk % 37 as spd, 40 + game_pk % 53 as temp, home_team = 26 as roof from market_v m) y) z) q""")
def key_factor_rules(t):
    h, a = F.concat(F.lit("T"), c("home_team").cast("string")), F.concat(F.lit("T"), c("away_team").cast("string"))
    g = c("game_pk")
    home_pick = c("p_model") >= 0.5
    f = labels.key_factors(
        home=h, away=a, pick=F.when(home_pick, h).otherwise(a), confidence=F.greatest("p_model", 1 - c("p_model")),
        edge=F.when(home_pick, c("p_model") - c("p_market")).otherwise(c("p_market") - c("p_model")),
        market_home=c("p_market"), model_home=c("p_model"), starters_known=g % 11 != 0, xfip_gap=(g % 9 - 4) / 4.0,
        home_streak=g % 17 - 8, away_streak=g % 19 - 9, home_momentum=(g % 23 - 11) / 10.0,
        away_momentum=(g % 29 - 14) / 10.0, wind_out=g % 31 - 15, temp_f=40 + g % 53, roof=c("home_team") == 26, wind_speed=g % 37)
    return t.market_v.select("game_pk", F.array_join(f, "; ").alias("factors"))


@query("eastern_date", """
select event_id, cast((ts at time zone 'UTC') at time zone 'America/New_York' as date) as game_date from events""")
def eastern_date(t):
    return t.events.select("event_id", labels.eastern_date(c("ts").cast("timestamp")).alias("game_date"))


@query("american_format", """
select game_pk, case when home_ml > 0 then '+' || cast(home_ml as bigint) else '' || cast(home_ml as bigint) end as price from odds_v""")
def american_format(t):
    return t.odds_v.select("game_pk", odds.american_format(c("home_ml")).alias("price"))


@query("lineup_status", """
select game_pk, case when game_pk % 2 = 0 and game_pk % 3 = 0 then 'both confirmed' when game_pk % 2 = 0 or game_pk % 3 = 0 then 'one confirmed' else 'pending' end as status from games_v""")
def lineup_status(t):
    out = lambda n: F.when(c("game_pk") % n == 0, True)
    return t.games_v.select("game_pk", labels.lineup_status(out(2), out(3)).alias("status"))


_STATUS = ["Final", "In Progress", "Delayed: Rain", "Pre-Game", "Scheduled", "Manager Challenge", "Review"]


@query("game_state_label", f"""
select game_pk, case when st like '%Final%' then 'Final ' || sc when st like '%Progress%' then case when game_pk % 2 = 0 then 'Top ' else 'Bottom ' end || i || ' ' || sc || ' ' || o || ' out'
 when ins = 'Middle' then 'Mid ' || i || ' ' || sc when ins = 'End' then 'End ' || i || ' ' || sc
 when st like '%Delayed%' then 'Delayed' when st like '%Pre-Game%' then 'Soon 7:05 PM' else '7:05 PM' end as state
from (select game_pk, {sql_list(_STATUS)}[game_pk % 7 + 1] as st, away_runs || '-' || home_runs as sc, cast(game_pk % 9 + 1 as varchar) as i,
 ['Top', 'Middle', 'Bottom', 'End'][(game_pk // 7) % 4 + 1] as ins, game_pk % 3 as o from games_v) x""")
def game_state_label(t):
    g = c("game_pk")
    label = labels.game_state_label(
        pick(_STATUS, g), g % 2 == 0, (g % 9 + 1).cast("string"), pick(["Top", "Middle", "Bottom", "End"], F.floor(g / 7)),
        c("away_runs"), c("home_runs"), g % 3, F.lit("7:05 PM"))
    return t.games_v.select("game_pk", label.alias("state"))


_STARTERS = ["TBD", " tb/a", "", "To Be Determined", "Unknown", "J. Smith", None]


@query("unknown_starter", """
select game_pk, game_pk % 7 <> 5 as unknown, case when game_pk % 7 = 5 then p_model - p_market end as edge from odds_v""")
def unknown_starter(t):
    name = F.element_at(F.array(*[F.lit(x) for x in _STARTERS]), (c("game_pk") % 7).cast("int") + 1)
    u = labels.unknown_starter(name)
    return t.odds_v.select("game_pk", u.alias("unknown"), F.when(~u, c("p_model") - c("p_market")).alias("edge"))


@query("transaction_label", f"""
select event_id, coalesce({sql_map(labels.TRANSACTION_LABELS)}[code], code) as type_label,
 case when to_t in ('NYY', 'BOS') then to_t when from_t in ('NYY', 'BOS') then from_t end as team
from (select event_id, ['IL', 'RM', 'TR', 'XX'][event_id % 4 + 1] as code, ['NYY', 'AAA', 'BOS'][event_id % 3 + 1] as to_t,
 ['BOS', 'AAA'][event_id % 2 + 1] as from_t from events) x""")
def transaction_label(t):
    e = c("event_id")
    return t.events.select(
        "event_id", labels.transaction_label(pick(["IL", "RM", "TR", "XX"], e)).alias("type_label"),
        labels.transaction_team(pick(["NYY", "AAA", "BOS"], e), pick(["BOS", "AAA"], e), ["NYY", "BOS"]).alias("team"))
