"""Labels, phases, badges and small blends."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fungo.functions.odds import percent_text

# Transaction code -> label.
TRANSACTION_LABELS = {"IL": "IL", "RM": "Activated", "TR": "Trade", "DES": "DFA", "SFA": "Called Up",
                      "SCR": "Optioned", "CLW": "Claimed", "REL": "Released"}
# Spellings of an unknown starter.
UNKNOWN_STARTERS = ("", "tbd", "tb/a", "to be determined", "unknown")


def season_phase(day: Column) -> Column:
    month = F.month(day)
    return F.when(month <= 4, "early").when(month >= 9, "late").when(month.isNotNull(), "mid").otherwise("unknown")


def recency_weight(year: Column) -> Column:
    return F.when(year >= 2023, 3.0).when(year == 2022, 2.0).when(year >= 2020, 1.5).otherwise(1.0)


def confidence_band(p: Column) -> Column:
    return F.when(p >= 0.65, "high").when(p >= 0.58, "medium").otherwise("low")


def trend_badge(momentum: Column) -> Column:
    return F.when(momentum >= 0.5, "hot").when(momentum <= -0.5, "cold").otherwise("")


def streak_badge(streak: Column) -> Column:
    n = F.abs(streak).cast("string")
    return F.when(streak >= 3, F.concat(F.lit("+"), n, F.lit("W"))).when(streak <= -3, F.concat(n, F.lit("L"))).otherwise("")


def lineup_status(home_out: Column, away_out: Column) -> Column:
    home, away = F.coalesce(home_out, F.lit(False)), F.coalesce(away_out, F.lit(False))
    return F.when(home & away, "both confirmed").when(home | away, "one confirmed").otherwise("pending")


def unknown_starter(name: Column) -> Column:
    return F.lower(F.trim(F.coalesce(name, F.lit("")))).isin(*UNKNOWN_STARTERS)


def game_state_label(status: Column, top: Column, inning: Column, inning_state: Column, away_runs: Column,
                     home_runs: Column, outs: Column, start_time: Column) -> Column:
    """One line about a running game."""
    score = F.concat_ws("-", away_runs.cast("string"), home_runs.cast("string"))
    half = F.when(top, "Top").otherwise("Bottom")
    return (F.when(status.contains("Final"), F.concat_ws(" ", F.lit("Final"), score))
            .when(status.contains("Progress"), F.concat_ws(" ", half, inning, score, outs.cast("string"), F.lit("out")))
            .when(inning_state == "Middle", F.concat_ws(" ", F.lit("Mid"), inning, score))
            .when(inning_state == "End", F.concat_ws(" ", F.lit("End"), inning, score))
            .when(status.contains("Delayed"), F.lit("Delayed"))
            .when(status.contains("Pre-Game") | status.contains("Warmup"), F.concat_ws(" ", F.lit("Soon"), start_time))
            .otherwise(start_time))


def transaction_label(code: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in TRANSACTION_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, code), code)


def transaction_team(to_team: Column, from_team: Column, known: list[str]) -> Column:
    return F.when(to_team.isin(*known), to_team).when(from_team.isin(*known), from_team)


def eastern_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def split_ids(packed: Column, n: int = 9) -> Column:
    """First n ids of a space-separated list; pieces that are no number are left out."""
    ids = F.transform(F.split(F.trim(packed), r"\s+"), lambda x: x.try_cast("bigint"))
    return F.slice(F.filter(ids, lambda x: x.isNotNull()), 1, n)


def sample_blend(cur: Column, prior: Column, sample: Column, enough: float = 150.0) -> Column:
    """Current value weighted by its sample, the rest from the prior; one-sided if either is missing."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), sample / enough))
    return F.when(cur.isNotNull() & prior.isNotNull(), cur * w + prior * (1 - w)).otherwise(F.coalesce(cur, prior))


def capped_blend(prior: Column, prior_n: Column, cur: Column, cur_n: Column, cap: float = 200.0) -> Column:
    """Sample-weighted mean of prior and current, the prior's weight held to ``cap``."""
    a = F.when(prior.isNotNull() & (prior_n > 0), F.least(prior_n.cast("double"), F.lit(cap))).otherwise(0.0)
    b = F.when(cur.isNotNull() & (cur_n > 0), cur_n.cast("double")).otherwise(0.0)
    return F.when(a + b > 0, (F.coalesce(prior, F.lit(0.0)) * a + F.coalesce(cur, F.lit(0.0)) * b) / (a + b))


def key_factors(*, home: Column, away: Column, pick: Column, confidence: Column, edge: Column, market_home: Column,
                model_home: Column, starters_known: Column, xfip_gap: Column, home_streak: Column,
                away_streak: Column, home_momentum: Column, away_momentum: Column, wind_out: Column,
                temp_f: Column, roof: Column, wind_speed: Column) -> Column:
    """Reasons behind a pick, in a fixed order; one general reason if none applies.

    Wind counts from 8 miles an hour.
    """

    def say(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    lower = F.when(xfip_gap >= 0.5, home).when(xfip_gap <= -0.5, away)
    edge_known = starters_known & edge.isNotNull()
    windy = ~roof & (wind_speed >= 8)
    rules = [
        F.when(~starters_known, say("starter not confirmed")),
        F.when(lower == pick, say("pitching edge: ", lower)).when(lower.isNotNull(), say("pitching concern: ", lower)),
        F.when(edge_known & (edge >= 0.05), say("market edge: ", percent_text(edge), " on ", pick)),
        F.when(edge_known & (edge >= 0.05) & (confidence < 0.55), say("value play, not a strong favorite: ", pick)),
        F.when(edge_known & (edge <= -0.05), say("market caution: ", percent_text(F.abs(edge)), " below on ", pick)),
    ]
    for team, streak, mom in ((home, home_streak, home_momentum), (away, away_streak, away_momentum)):
        n = F.abs(streak).cast("string")
        rules += [
            F.when(streak >= 4, say(team, " won ", n, " straight")).when(streak <= -4, say(team, " lost ", n, " straight")),
            F.when(mom >= 0.7, say(team, " trending up")).when(mom <= -0.7, say(team, " cooling off")),
        ]
    rules += [
        F.when(starters_known & (pick == home) & (market_home < 0.5) & (model_home > 0.52), say("home underdog value: ", home)),
        F.when(windy & (wind_out >= 7), say("wind blowing out")).when(windy & (wind_out <= -7), say("wind blowing in")),
        F.when(~roof & (temp_f >= 88), say("hot weather")).when(~roof & (temp_f <= 45), say("cold weather")),
    ]
    found = F.array_compact(F.array(*rules))
    plain = F.array(say("model gives ", pick, " ", percent_text(confidence)))
    return F.when(F.size(found) > 0, found).otherwise(plain)
