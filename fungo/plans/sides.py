"""Games to one row per side and back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fungo.operators.project import symmetric

GAME = ("game_pk", "game_date", "season")


def team_games(games: DataFrame) -> DataFrame:
    """One row per (team, game) with runs for and against."""
    side = lambda us, them: {"team": f"{us}_team", "opponent": f"{them}_team", "rf": f"{us}_runs", "ra": f"{them}_runs",
                             "run_diff": F.col(f"{us}_runs") - F.col(f"{them}_runs")}
    return symmetric(games, GAME, side("home", "away"), side("away", "home"))


def by_side(games: DataFrame, cols: Sequence[str] = ("team",), common: Sequence[str] = GAME) -> DataFrame:
    """One row per side with the side's own columns and the other side's as opp_*."""
    side = lambda us, them: {**{c: f"{us}_{c}" for c in cols}, **{f"opp_{c}": f"{them}_{c}" for c in cols}}
    return symmetric(games, common, side("home", "away"), side("away", "home"))


def to_game(rows: DataFrame, cols: Mapping[str, str | Column] | Sequence[str], key: str = "game_pk") -> DataFrame:
    """Side rows back to one row per game: home_x and away_x, in one shuffle on the game."""
    cols = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    pick = lambda side, c: F.max(F.when(F.col("venue") == side, F.col(c) if isinstance(c, str) else c))
    return rows.groupBy(key).agg(*[pick(s, c).alias(f"{s}_{n}") for n, c in cols.items() for s in ("home", "away")])
