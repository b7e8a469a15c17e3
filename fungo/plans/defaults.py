"""Neutral values and differences of the feature table."""

from __future__ import annotations

# Neutral value of a feature that exists for both teams (home_x, away_x).
SIDE_DEFAULTS = {
    "prior_win_pct": 0.5, "season_win_pct": 0.5, "season_win_pct_delta": 0.0,
    "il_count": 0.0, "il_war": 0.0,
    "sp_era_adj": 4.3, "sp_inseason_era": 4.3, "sp_last3_era": 4.3, "bullpen_inseason_era": 4.3,
    "offense_re24_15g": 0.0, "sp_re24_last3": 0.0, "bullpen_re24_15d": 0.0,
    "sp_fbv": 93.0, "sp_swstr": 0.11, "sp_k_pct": 0.22, "sp_xfip": 4.3, "sp_pa": 0.0,
    "sp_days_rest": 5.0, "sp_outs_last": 15.0, "bullpen_outs_3d": 0.0,
    "team_ops": 0.720, "batting_ops_vs_sp": 0.720, "platoon_advantage": 0.0,
    "lineup_ops_vs_sp": 0.720, "lineup_ops_vs_lhp": 0.720, "lineup_ops_vs_rhp": 0.720, "lineup_known_batters": 0.0,
    # contact rates are fractions here, as in the data they stand for
    "barrel_pct": 0.07, "hard_hit_pct": 0.38,
    "home_rd": 0.0, "away_rd": 0.0, "rd_split": 0.0,
    "opp_sp_is_lhp": 0.0, "sp_is_lhp": 0.0,
}

# Neutral value of a feature of the game.
GAME_DEFAULTS = {
    "h2h_home_win_rate": 0.5, "h2h_home_run_diff": 0.0,
    "temp_f": 70.0, "wind_speed_mph": 0.0, "wind_to_cf": 0.0, "humidity_pct": 55.0, "ump_run_factor": 1.0,
    "rd_venue_diff": 0.0, "away_travel_miles": 0.0, "travel_diff": 0.0, "vegas_home_prob": 0.5, "park_factor": 1.0,
    "both_sp_same_hand": 0.0,
}

NEUTRAL = {**GAME_DEFAULTS, **{f"{side}_{k}": v for k, v in SIDE_DEFAULTS.items() for side in ("home", "away")}}

# Difference -> feature, home minus away ...
MORE_IS_BETTER = {
    "prior_win_pct_diff": "prior_win_pct", "season_win_pct_diff": "season_win_pct",
    "season_win_pct_delta_diff": "season_win_pct_delta", "il_diff": "il_count", "il_war_diff": "il_war",
    "offense_re24_diff": "offense_re24_15g", "sp_re24_diff": "sp_re24_last3", "bullpen_re24_diff": "bullpen_re24_15d",
    "sp_fbv_diff": "sp_fbv", "sp_swstr_diff": "sp_swstr", "sp_k_pct_diff": "sp_k_pct", "sp_pa_diff": "sp_pa",
    "sp_days_rest_diff": "sp_days_rest", "sp_outs_last_diff": "sp_outs_last", "ops_diff": "team_ops",
    "batting_ops_vs_sp_diff": "batting_ops_vs_sp", "platoon_advantage_diff": "platoon_advantage",
    "lineup_ops_vs_sp_diff": "lineup_ops_vs_sp", "lineup_ops_vs_lhp_diff": "lineup_ops_vs_lhp",
    "lineup_ops_vs_rhp_diff": "lineup_ops_vs_rhp", "lineup_known_batters_diff": "lineup_known_batters",
    "barrel_pct_diff": "barrel_pct", "hard_hit_pct_diff": "hard_hit_pct",
}
# ... and away minus home, where less is better.
LESS_IS_BETTER = {
    "sp_era_adj_diff": "sp_era_adj", "sp_inseason_era_diff": "sp_inseason_era", "sp_last3_era_diff": "sp_last3_era",
    "bullpen_inseason_era_diff": "bullpen_inseason_era", "sp_xfip_diff": "sp_xfip", "bullpen_usage_diff": "bullpen_outs_3d",
}
# Form differences that exist before any fill.
FORM_DIFFS = {"rd_diff": "rolling_rd", "rs_diff": "rolling_rs", "last7_rd_diff": "last7_rd", "momentum_diff": "momentum",
              "streak_diff": "streak", "rest_diff": "days_rest"}

DIFF_PAIRS = {
    **{d: (f"home_{x}", f"away_{x}") for d, x in MORE_IS_BETTER.items()},
    **{d: (f"away_{x}", f"home_{x}") for d, x in LESS_IS_BETTER.items()},
}
