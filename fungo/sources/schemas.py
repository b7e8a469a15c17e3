"""Schemas of the source tables and the read boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

TABLES = {
    "game_logs": "game_id string, game_date date, year int, home_team string, away_team string, home_runs int, away_runs int, home_win int, game_number int, game_pk bigint",
    "game_starters": "game_date date, year int, home_team string, away_team string, game_number int, game_pk bigint, home_sp_id string, home_sp_name string, away_sp_id string, away_sp_name string",
    "pitcher_game_logs": "game_date date, game_id string, home_team string, away_team string, pitcher_id string, pitcher_name string, team_side int, is_starter boolean, outs_recorded int, runs_allowed int",
    "umpire_game_logs": "game_date date, game_id string, home_team string, away_team string, ump_name string",
    "pitcher_stuff": "name_norm string, team string, year int, Throws string, FBv double, SwStr_pct double, K_pct double, xFIP double, GS int, pa int",
    "statcast_batting": "team string, barrel_pct double, hard_hit_pct double, avg_exit_velo double, year int",
    "team_splits": "team string, year int, ops_vs_lhp double, ops_vs_rhp double, pa_vs_lhp int, pa_vs_rhp int",
    "game_weather": "date date, home_team string, temp_f double, wind_speed_mph double, wind_dir_deg double, humidity_pct double",
    "il_counts": "date date, team string, il_count int",
    "il_quality": "date date, team string, il_war_score double",
    "player_war": "name_norm string, year int, war double",
    "game_odds": "game_date date, home_team string, away_team string, game_number int, home_ml double, away_ml double, consensus_prob double, open_home_ml double, open_away_ml double, close_home_ml double, close_away_ml double",
    "transactions": "date date, team string, player string, type_code string, type_label string, description string",
    "bankroll_ledger": "date date, matchup string, bet_side string, stake double, odds double, won boolean, pnl decimal(18,2), bankroll decimal(18,2), notes string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are null inside the engine; NaN ends here."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in floats}) if floats else df
