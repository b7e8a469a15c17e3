"""American odds, implied probabilities, stakes and results as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Price ranges, closed on the left and open on the right.
ODDS_BUCKETS = (
    ("<-180", -math.inf, -180.0),
    ("-180:-140", -180.0, -140.0),
    ("-140:-115", -140.0, -115.0),
    ("-115:+100", -115.0, 100.0),
    ("+100:+130", 100.0, 130.0),
    ("+130:+170", 130.0, 170.0),
    ("+170+", 170.0, math.inf),
)


def implied_prob(ml: Column) -> Column:
    return F.when(ml > 0, 100 / (ml + 100)).when(ml.isNotNull(), F.abs(ml) / (F.abs(ml) + 100))


def devig(home_ml: Column, away_ml: Column) -> Column:
    home, away = implied_prob(home_ml), implied_prob(away_ml)
    return F.when(home + away > 0, home / (home + away))


def overround(home_ml: Column, away_ml: Column) -> Column:
    return implied_prob(home_ml) + implied_prob(away_ml)


def net_odds(ml: Column) -> Column:
    """Profit per unit staked; null for a price of 0."""
    return F.when(ml > 0, ml / 100).when(ml < 0, 100 / F.abs(ml))


def flat_profit(ml: Column, won: Column) -> Column:
    return F.when(won, net_odds(ml)).when(~won, F.lit(-1.0))


def odds_bucket(ml: Column) -> Column:
    label = None
    for name, lo, hi in ODDS_BUCKETS:
        if math.isinf(hi):
            continue
        label = F.when(ml < hi, name) if label is None else label.when(ml < hi, name)
    return label.when(ml.isNotNull(), ODDS_BUCKETS[-1][0])


def kelly_fraction(p: Column, ml: Column, frac: float | Column = 0.25, cap: float | Column = 0.10) -> Column:
    """Share of the bankroll: min(frac * edge / net, cap), 0 without a positive edge."""
    net = net_odds(ml)
    edge = p * net - (1 - p)
    frac, cap = (c if isinstance(c, Column) else F.lit(c) for c in (frac, cap))
    return F.when((net > 0) & (edge > 0), F.least(frac * (edge / net), cap)).otherwise(F.lit(0.0))


def money(x: Column) -> Column:
    """Cents as a decimal. Rounding goes through six decimals, so it does not depend
    on how a double is printed."""
    return F.round(x.cast("decimal(24,6)"), 2).cast("decimal(18,2)")


def pnl(stake: Column, ml: Column, won: Column) -> Column:
    """Result of a bet in money; 0 while it is pending or the price is 0."""
    zero = F.lit(0).cast("decimal(18,2)")
    net = F.coalesce(net_odds(ml), F.lit(0.0)).cast("decimal(18,6)")
    return (F.when(won & (ml != 0), F.round(stake.cast("decimal(18,2)") * net, 2).cast("decimal(18,2)"))
            .when(~won & (ml != 0), -stake.cast("decimal(18,2)"))
            .otherwise(zero))


def american_format(ml: Column) -> Column:
    n = ml.cast("bigint")
    return F.when(ml > 0, F.concat(F.lit("+"), n.cast("string"))).when(ml.isNotNull(), n.cast("string"))


def percent_text(p: Column) -> Column:
    """One-decimal percent text, halves rounded up."""
    k = F.floor(F.abs(p) * 1000 + 0.5).cast("bigint")
    return F.concat(F.when(p < 0, "-").otherwise(""), F.floor(k / 10).cast("string"), F.lit("."),
                    (k % 10).cast("string"), F.lit("%"))
