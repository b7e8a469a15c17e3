"""The feature matrix: all feature groups keyed by game, joined once."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fungo.operators import project as p
from fungo.plans import defaults as d, form

IDS = ["game_pk", "game_number", "game_date", "season", "home_team", "away_team", "home_runs", "away_runs", "home_win"]
REQUIRED = ["home_rolling_rd", "away_rolling_rd"]


def combine(games: DataFrame, groups: Sequence[DataFrame]) -> DataFrame:
    """Left joins on the game; every group has one row per game, so rows cannot multiply."""
    return functools.reduce(lambda df, g: df.join(g, "game_pk", "left"), groups, games)


# Difference -> its two sides, before any fill.
FIRST_DIFFS = {**{n: (f"home_{x}", f"away_{x}") for n, x in d.FORM_DIFFS.items()}, **d.DIFF_PAIRS,
               "travel_diff": ("away_travel_miles", "home_travel_miles"), "rd_venue_diff": ("home_home_rd", "away_away_rd"),
               "home_season_win_pct_delta": ("home_season_win_pct", "home_prior_win_pct"),
               "away_season_win_pct_delta": ("away_season_win_pct", "away_prior_win_pct"),
               "home_rd_split": ("home_home_rd", "home_away_rd"), "away_rd_split": ("away_home_rd", "away_away_rd")}


def differences(df: DataFrame) -> DataFrame:
    """Every difference whose two sides exist, and calendar columns."""
    have = set(df.columns)
    first = {n: F.col(a) - F.col(b) for n, (a, b) in FIRST_DIFFS.items() if {a, b} <= have}
    return p.calendar_features(df.withColumns(first), "game_date")


def feature_matrix(games: DataFrame, groups: Sequence[DataFrame]) -> DataFrame:
    """Ids, features with neutral fills and differences; games without enough history are dropped."""
    wide = differences(combine(games.select(*IDS), groups))
    # kept only where both teams have enough earlier games
    ready = p.drop_incomplete(wide, REQUIRED)
    filled = p.fill_neutral(ready, {k: v for k, v in d.NEUTRAL.items() if k not in IDS})
    return p.recompute_diffs(filled, d.DIFF_PAIRS)


def form_matrix(games: DataFrame) -> DataFrame:
    """The smallest useful matrix: form, meetings and last season's record."""
    return feature_matrix(games, [form.team_form(games), form.head_to_head(games), form.prior_pythagorean(games)])
