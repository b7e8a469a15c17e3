"""Market prices onto games."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fungo.functions import odds
from fungo.operators import joins as j, ordered as o

KEY = ["game_date", "home_team", "away_team", "game_number"]


def market_attach(games: DataFrame, prices: DataFrame, fetched: str = "fetched_at") -> DataFrame:
    """Vig-free home probability from the latest quote of each game.

    Among several stored quotes of a game the last one fetched counts. Prices that
    cannot be American odds are left out.
    """
    valid = prices.filter((F.abs("home_ml") >= 100) & (F.abs("away_ml") >= 100))
    last = o.latest(valid, KEY, [fetched], ["home_ml", "away_ml"])
    probs = last.select(*KEY, odds.devig(F.col("home_ml"), F.col("away_ml")).alias("vegas_home_prob"))
    return j.game_key_join(games, probs).select("game_pk", "vegas_home_prob")
