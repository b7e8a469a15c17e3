"""Game-shaped views over the base tables.

Each view is a deterministic projection of the driver's tables, so its size grows
with them. The text runs unchanged in Spark and in DuckDB; the oracle inlines it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

BASE = ("region nation customer supplier part orders lineitem events documents "
        "embeddings pages benchmark labels conversations").split()

VIEWS: dict[str, str] = {
    "games_v": """
select game_pk, game_date, cast(year(game_date) as int) as season, home_team, away_team,
 cast(hr + case when hr = ar then 1 else 0 end as int) as home_runs, cast(ar as int) as away_runs,
 cast(case when hr >= ar then 1 else 0 end as int) as home_win,
 cast(row_number() over (partition by game_date, home_team, away_team order by game_pk) as int) as game_number
from (select o_orderkey as game_pk, cast(o_orderdate as date) as game_date,
        cast(o_custkey % 30 as int) as home_team, cast((o_custkey % 30 + 1 + o_orderkey % 29) % 30 as int) as away_team,
        c % 11 as hr, cast(floor(c / 11) as bigint) % 10 as ar
      from (select o_orderkey, o_custkey, o_orderdate, cast(round(o_totalprice * 100) as bigint) as c from orders) t) u""",
    "team_games_v": """
select game_pk, game_date, season, home_team as team, away_team as opponent, 'home' as venue, home_runs as rf, away_runs as ra, home_runs - away_runs as run_diff from games_v
union all select game_pk, game_date, season, away_team, home_team, 'away', away_runs, home_runs, away_runs - home_runs from games_v""",
    "appearances_v": """
select l_orderkey as game_pk, l_suppkey as pitcher_id, cast(l_suppkey % 2 as int) as team_side,
 cast(max(case when l_linenumber <= 2 then 1 else 0 end) as int) as is_starter,
 cast(cast(sum(l_quantity) as bigint) % 28 as int) as outs_recorded,
 cast(cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) % 8 as int) as runs_allowed
from lineitem group by l_orderkey, l_suppkey, cast(l_suppkey % 2 as int)""",
    "odds_v": """
select game_pk, p_market, p_model,
 cast(case when q >= 0.5 then -floor(100 * q / (1 - q)) else floor(100 * (1 - q) / q) end as double) as home_ml,
 cast(case when r >= 0.5 then -floor(100 * r / (1 - r)) else floor(100 * (1 - r) / r) end as double) as away_ml
from (select game_pk, p_market, p_model, p_market * cast(1.045 as double) as q, (1 - p_market) * cast(1.045 as double) as r
  from (select o_orderkey as game_pk, cast((3000 + (o_orderkey * 7919) % 4001) as double) / 10000 as p_market,
    cast((3000 + (o_orderkey * 7919) % 4001 + (o_orderkey * 104729) % 2001 - 1000) as double) / 10000 as p_model from orders) a) b""",
    "snapshots_v": """
select cast(date_trunc('month', o_orderdate) as date) as snap_date, cast(o_custkey % 30 as int) as team, cast(count(*) as bigint) as il_count
from orders where month(o_orderdate) between 4 and 10 group by 1, 2""",
    "plays_v": """
select event_id as play_id, user_id, cast(ts as date) as play_date, ts, event_type as state_before, cast(event_id % 4 as int) as runs_scored from events""",
    "quotes_v": """
select event_id as quote_id, ts, user_id as game_key, event_type as book, value as price from events""",
    # a game with its prices and both probabilities
    "market_v": """
select g.game_pk, g.game_date, g.season, g.home_team, g.away_team, g.home_win, g.game_number,
 o.p_model, o.p_market, o.home_ml, o.away_ml
from games_v g join odds_v o on g.game_pk = o.game_pk""",
    # an appearance with its date, season and the pitcher's team
    "dated_appearances_v": """
select a.game_pk, a.pitcher_id, a.team_side, a.is_starter, a.outs_recorded, a.runs_allowed,
 g.game_date, g.season, case when a.team_side = 1 then g.home_team else g.away_team end as team
from appearances_v a join games_v g on a.game_pk = g.game_pk""",
    # both starters of a game
    "starters_v": """
select game_pk, max(case when team_side = 1 then pid end) as home_sp_id, max(case when team_side = 0 then pid end) as away_sp_id
from (select game_pk, team_side, min(pitcher_id) as pid from appearances_v where is_starter = 1 group by game_pk, team_side) s group by game_pk""",
    "staffed_games_v": """
select g.game_pk, g.game_date, g.season, g.home_team, g.away_team, g.home_runs, g.away_runs, g.home_win, g.game_number, s.home_sp_id, s.away_sp_id,
 concat('p', cast(s.home_sp_id as varchar(20))) as home_name_norm, concat('p', cast(s.away_sp_id as varchar(20))) as away_name_norm
from games_v g join starters_v s on g.game_pk = s.game_pk""",
    # season statistics per pitcher and team
    "pitcher_stats_v": """
select concat('p', cast(pitcher_id as varchar(20))) as name_norm, season, team, cast(sum(is_starter) as bigint) as gs,
 case when sum(outs_recorded) > 0 then cast(sum(runs_allowed) as double) * 27 / sum(outs_recorded) end as era, cast(sum(outs_recorded) as bigint) as pa
from dated_appearances_v where (pitcher_id + season) % 5 <> 0 group by pitcher_id, season, team""",
    # plays with base/out states, from order lines
    "impact_plays_v": """
select l.l_orderkey as game_pk, g.game_date, g.season, l.l_linenumber as play, l.l_partkey as batter, l.l_suppkey as pitcher_id, cast(l.l_suppkey % 2 as int) as batting_side,
 case when l.l_suppkey % 2 = 0 then g.away_team else g.home_team end as batting_team, case when l.l_suppkey % 2 = 0 then g.home_team else g.away_team end as pitching_team,
 cast(case when l.l_linenumber <= 2 then 1 else 0 end as int) as is_starter,
 concat(cast(l.l_partkey % 3 as varchar(1)), '_', cast(l.l_suppkey % 8 as varchar(1))) as state_before, concat(cast((l.l_partkey + 1) % 3 as varchar(1)), '_', cast((l.l_suppkey + 3) % 8 as varchar(1))) as state_after,
 cast(l.l_partkey % 4 as int) as outs_after, cast(cast(l.l_quantity as bigint) % 3 as int) as runs_scored
from lineitem l join games_v g on g.game_pk = l.l_orderkey""",
}

_NAMES = [*VIEWS, *BASE]
_WORD = re.compile(r"\b(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")\b")


def _deps(text: str, names) -> list[str]:
    return [n for n in dict.fromkeys(_WORD.findall(text)) if n in names]


class Tables:
    """Lazy access to base tables and views: ``t.orders``, ``t.games_v``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in _NAMES:
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                df = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name == "team_games_v":
                df = self._team_games()
            else:
                df = self.sql(VIEWS[name])
            self._made[name] = df
        return self._made[name]

    def _team_games(self) -> DataFrame:
        """Both sides of a game from one scan; the SQL text is its oracle."""
        from fungo.operators.project import symmetric

        side = lambda us, them: {"team": f"{us}_team", "opponent": f"{them}_team", "rf": f"{us}_runs",
                                 "ra": f"{them}_runs", "run_diff": F.col(f"{us}_runs") - F.col(f"{them}_runs")}
        return symmetric(self.games_v, ["game_pk", "game_date", "season"], side("home", "away"), side("away", "home"))

    def sql(self, text: str, **extra: DataFrame) -> DataFrame:
        """Run SQL whose table names are base tables, views or ``extra`` frames."""
        frames = {n: getattr(self, n) for n in _deps(text, _NAMES)}
        frames.update(extra)
        words = re.compile(r"\b(" + "|".join(sorted(frames, key=len, reverse=True)) + r")\b")
        # column references such as events.ts do not occur: tables are always aliased
        return self.spark.sql(words.sub(r"{\1}", text), **frames)


def oracle(text: str, ctes: dict[str, str] | None = None) -> str:
    """Prefix a DuckDB query with the views it reads."""
    ctes = ctes or {}
    wanted: dict[str, str] = {}

    def need(body: str) -> None:
        for n in _deps(body, VIEWS):
            if n not in wanted:
                need(VIEWS[n])
                wanted[n] = VIEWS[n]

    for body in [*ctes.values(), text]:
        need(body)
    wanted.update(ctes)
    if not wanted:
        return text
    head = ",\n".join(f"{n} as ({b})" for n, b in wanted.items())
    return f"with {head}\n{text}"
