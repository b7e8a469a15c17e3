"""Team form: rolling results, streaks, season record, meetings, the form board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fungo.operators import joins as j, ordered as o, project as p
from fungo.plans.sides import team_games, to_game
from fungo.sources.shelf import Shelf

ORDER = ["game_date", "game_pk"]
NEAR = ("team", "game_date")
# Frame lengths and least games.
LONG, SHORT, VENUE, SEASON_LEAST = (15, 5), (7, 3), (15, 3), 10


def won() -> Column:
    return F.when(F.col("run_diff") > 0, 1).when(F.col("run_diff").isNotNull(), 0)


def _placed(rows: DataFrame, inclusive: bool = False, shelf: Shelf | None = None) -> DataFrame:
    """Rows with their place in the team's order, ``_at_team``, and the scored games up to them; by team and day on a ``shelf``."""
    placed = o.expanding(rows, ["team"], ORDER, {"_at_team": ("count", F.lit(1)), "_scored": ("count", "run_diff")}, inclusive=True)
    return placed if shelf is None else shelf.put("placed_after" if inclusive else "placed", placed, ["team", "game_date"])


def _record(placed: DataFrame, rows: DataFrame, kw: dict, near: tuple = ()) -> DataFrame:
    """Streak and season record, which are known on the team's days."""
    out = o.signed_streak(placed, ["team"], ORDER, "run_diff", source=placed, counted="_scored", **kw)
    out = o.expanding(out, ["team", "season"], ORDER, {"_wins": ("sum", won()), "_games": ("count", won())}, source=rows, near=near, **kw)
    return out.withColumn("season_win_pct", F.when(F.col("_games") >= SEASON_LEAST, F.col("_wins") / F.col("_games"))).drop("_wins", "_games", "_scored")


def _at_venue(placed: DataFrame, rows: DataFrame, near: tuple = ()) -> DataFrame:
    return o.ranked(placed, ["team", "venue"], ORDER, "_at_venue", source=rows, near=near)


def _team_frames(rows: DataFrame, kw: dict) -> DataFrame:
    out = o.rolling_prior(rows, ["team"], ORDER, {
        "rolling_rd": ("avg", "run_diff", *LONG), "rolling_rs": ("avg", "rf", *LONG), "last7_rd": ("avg", "run_diff", *SHORT)}, position="_at_team", **kw)
    return out.withColumn("momentum", F.col("last7_rd") - F.col("rolling_rd")).drop("_at_team")


def _venue_frames(rows: DataFrame, kw: dict) -> DataFrame:
    return o.rolling_prior(rows, ["team", "venue"], ORDER, {"venue_rd": ("avg", "run_diff", *VENUE)}, position="_at_venue", **kw).drop("_at_venue")


def form_rows(rows: DataFrame, inclusive: bool = False, shelf: Shelf | None = None) -> DataFrame:
    """Rolling form per (team, game): going into the game, or after it if ``inclusive``.

    Everything that works on team-days comes first and shares one shuffle; the two
    rolling frames follow. With a ``shelf`` the placed rows are written there by team and
    day, so that the four running aggregates read them without one.
    """
    kw = {"inclusive": inclusive}
    placed = _placed(rows, inclusive, shelf)
    if shelf is not None:
        rows = placed
    out = _at_venue(_record(placed, rows, kw), rows)
    return _venue_frames(_team_frames(out, kw), kw)


def team_form(games: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """Form of both teams going into each game; the venue form of a team is known only at that venue.

    With a ``shelf`` the frames over a team's games and those over its games at a venue are
    two tables there, written one after the other, so that the exchanges of one only lie on
    disk at a time; the placed rows go again.
    """
    at = lambda v: F.when(F.col("venue") == v, F.col("venue_rd"))
    team = {x: x for x in ("rolling_rd", "rolling_rs", "last7_rd", "momentum", "streak", "season_win_pct")}
    venue = {"home_rd": at("home"), "away_rd": at("away")}
    if shelf is None:
        return to_game(form_rows(team_games(games)), {**team, **venue})
    placed, kw = _placed(team_games(games).drop("opponent", "ra"), shelf=shelf), {"inclusive": False}
    by_team = shelf.put("form", to_game(_team_frames(_record(placed, placed, kw, NEAR), kw), team), ["game_pk"], dealt=True)
    at_venue = _at_venue(placed.select("team", "venue", *ORDER, "run_diff"), placed, NEAR)
    by_venue = shelf.put("venue_form", to_game(_venue_frames(at_venue, kw), venue), ["game_pk"], dealt=True)
    shelf.drop("placed")
    return by_team.join(by_venue, "game_pk", "left")


def head_to_head(games: DataFrame, n: int = 10, least: int = 3) -> DataFrame:
    """The home team's record in the last meetings, whoever was at home then."""
    out = o.rolling_prior(team_games(games), ["team", "opponent"], ORDER, {
        "h2h_home_win_rate": ("avg", won(), n, least), "h2h_home_run_diff": ("avg", "run_diff", n, least)})
    return out.filter("venue = 'home'").select("game_pk", "h2h_home_win_rate", "h2h_home_run_diff")


def prior_pythagorean(games: DataFrame) -> DataFrame:
    """Expected win rate from last season's runs, for both teams."""
    from fungo.operators.aggregates import pythagorean_pct

    rows = team_games(games)
    out = j.prior_season_join(rows, F.broadcast(pythagorean_pct(rows)), ["team"])
    return to_game(out, {"prior_win_pct": "pyth_pct"})


def form_board(games: DataFrame, n: int = 5) -> DataFrame:
    """Current form per team with hottest and coldest lists."""
    after = form_rows(team_games(games), inclusive=True)
    now = o.latest(after, ["team"], ORDER, ["game_date", "game_pk", "rolling_rd", "last7_rd", "streak", "momentum"])
    return p.top_bottom_n(now.drop("game_pk"), "momentum", "team", n)
