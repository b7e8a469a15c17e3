"""Point-in-time features for games to come, as joins over a request table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fungo.functions import geo
from fungo.operators import joins as j, ordered as o
from fungo.plans import form
from fungo.plans.sides import by_side, team_games, to_game
from fungo.sources.shelf import Shelf

STATE = ["rolling_rd", "rolling_rs", "last7_rd", "momentum", "streak", "season_win_pct"]


def matchup_rows(requests: DataFrame, games: DataFrame, snapshots: DataFrame, relief: DataFrame, parks: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """Features of requested games from everything known before their day.

    ``requests`` has game_pk (the request's id), game_date, season, home_team and
    away_team. Form is the state after each team's last game before that day, so it
    includes that game.
    """
    asks = by_side(requests.withColumns({"home_place": F.col("home_team"), "away_place": F.col("home_team")}), ["team", "place"])
    played = team_games(games)
    here = F.when(F.col("venue") == "home", F.col("team")).otherwise(F.col("opponent"))
    after = form.form_rows(played, inclusive=True, shelf=shelf).withColumns({"last_place": here, "last_season": F.col("season"), "last_day": F.col("game_date")})
    after = after.select("team", F.col("game_date").alias("_day"), "game_pk", *STATE, "last_place", "last_season", "last_day")
    rows = j.asof_union(asks, ["team"], "game_date", {
        "form": j.Source(after, "_day", [*STATE, "last_place", "last_season", "last_day"], inclusive=False, tie=["game_pk"]),
        "lists": j.Source(snapshots, "snap_date", ["il_count"])}, sums=(relief, "outs_recorded", 3))
    rows = rows.select(*asks.columns, *[F.col(f"form.{x}") for x in [*STATE, "last_place", "last_season", "last_day"]], F.col("lists.il_count"),
                       F.col("outs_recorded_sum").alias("bullpen_outs_3d"))
    rows = rows.withColumns({
        "season_win_pct": F.when(F.col("last_season") == F.col("season"), F.col("season_win_pct")),
        "days_rest": F.greatest(F.lit(0), F.least(F.lit(7), F.datediff("game_date", "last_day") - 1))})
    spot = lambda n, key: F.broadcast(parks.select(F.col("team").alias(key), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon")))
    rows = rows.join(spot("a", "last_place"), "last_place", "left").join(spot("b", "place"), "place", "left")
    miles = geo.haversine_miles(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    rows = rows.withColumn("travel_miles", F.when(F.col("last_place") == F.col("place"), 0.0).otherwise(miles))
    meet = o.rolling_prior(played, ["team", "opponent"], form.ORDER, {
        "h2h_win_rate": ("avg", form.won(), 10, 3), "h2h_run_diff": ("avg", "run_diff", 10, 3)}, inclusive=True)
    meet = meet.select("team", F.col("opponent").alias("opp_team"), F.col("game_date").alias("_met"), "game_pk", "h2h_win_rate", "h2h_run_diff")
    rows = j.asof_union(rows, ["team", "opp_team"], "game_date", {"meet": j.Source(meet, "_met", ["h2h_win_rate", "h2h_run_diff"], inclusive=False, tie=["game_pk"])}, asked=asks)
    rows = rows.select("*", "meet.h2h_win_rate", "meet.h2h_run_diff")
    cols = [*STATE, "days_rest", "travel_miles", "il_count", "bullpen_outs_3d", "h2h_win_rate", "h2h_run_diff"]
    return to_game(rows, cols).drop("away_h2h_win_rate", "away_h2h_run_diff").withColumnsRenamed(
        {"home_h2h_win_rate": "h2h_home_win_rate", "home_h2h_run_diff": "h2h_home_run_diff"})
