"""Bankroll paths. Money is decimal cents.

A compounding path with a rounding at every bet is a sequence: each stake needs
the balance before it. ``ledger_fold`` therefore streams a group's bets in order with one
balance; groups run in parallel and should be short, such as an account's season. Where stakes do not depend on the balance (``ledger_fixed``,
``recalculate_ledger``) or rounding is left out (``ledger_closed_form``), the path is
a running aggregate and fully parallel.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from fungo.functions import odds
from fungo.operators import ordered
from fungo.operators.fold import ordered_end, ordered_fold

CENTS = "decimal(18,2)"
# money of a path: every whole number of cents that a bigint holds
PATH = "decimal(19,2)"
UNIT_F, UNIT_N = 10**8, 10**6


def _half_up(num: int, den: int) -> int:
    return (2 * num + den) // (2 * den)


def _held(cents: int) -> int | None:
    """Cents as a bigint column holds them; null for more, as a compounding path has no bound."""
    return cents if -2**63 <= cents < 2**63 else None


def _bet(state: tuple, bet: tuple) -> tuple[tuple, int, int]:
    """One bet, in whole cents of any size: the balance after it, stake and result."""
    (balance,), (share, net, won) = state, bet
    balance = int(balance)
    stake = _half_up(balance * int(share), UNIT_F) if balance > 0 else 0
    result = _half_up(stake * int(net), UNIT_N) if won == 1 else (-stake if won == 0 else 0)
    return (balance + result,), stake, result


def _settle(state: tuple, bet: tuple) -> tuple[tuple, tuple]:
    after, stake, result = _bet(state, bet)
    return after, (_held(stake), _held(result), _held(*after))


def _prepared(bets: DataFrame, share: Column, ml: Column, won: Column) -> DataFrame:
    return bets.withColumns({
        "_share": F.floor(share * UNIT_F + 0.5).cast("bigint"),
        "_net": F.floor(F.coalesce(odds.net_odds(ml), F.lit(0.0)) * UNIT_N + 0.5).cast("bigint"),
        "_won": F.coalesce(won.cast("int"), F.lit(-1)),
    })


def _dollars(name: str) -> Column:
    return (F.col(name).cast("decimal(20,0)") / 100).cast(PATH)


def ledger_fold(bets: DataFrame, group: Sequence[str], order: Sequence[str], share: Column, ml: Column, won: Column,
                start: float = 100.0) -> DataFrame:
    """Per-bet stake, pnl and balance, each group starting from ``start``.

    stake = round(balance * share, 2); pnl = round(stake * net odds, 2) when won,
    -stake when lost, 0 while pending. The balance is exact at any size; an amount of
    2^63 cents or more is null in its row.
    """
    path = ordered_fold(_prepared(bets, share, ml, won), group, order, ["_share", "_net", "_won"], _settle,
                        {"_stake": "bigint", "_pnl": "bigint", "_after": "bigint"}, (int(round(start * 100)),))
    return path.select(*bets.columns, _dollars("_stake").alias("stake"), _dollars("_pnl").alias("pnl"), _dollars("_after").alias("bankroll"),
                       F.col("_pos").alias("bet_number"))


def ledger_fixed(bets: DataFrame, group: Sequence[str], order: Sequence[str], share: Column, ml: Column, won: Column,
                 start: float = 100.0) -> DataFrame:
    """Stakes are a share of the starting bankroll; the balance is a running sum."""
    staked = bets.withColumn("stake", odds.money(share * F.lit(float(start))))
    settled = staked.withColumn("pnl", odds.pnl(staked["stake"], ml, won))
    out = ordered.expanding(settled, group, order, {"bankroll": ("sum", "pnl")}, inclusive=True)
    return out.withColumn("bankroll", (F.col("bankroll") + F.lit(start).cast(CENTS)).cast(CENTS))


def ledger_closed_form(bets: DataFrame, group: Sequence[str], order: Sequence[str], share: Column, ml: Column, won: Column,
                       start: float = 100.0) -> DataFrame:
    """Compounding without rounding: start * exp(running sum of log(1 + share * return))."""
    step = F.log1p(share * odds.flat_profit(ml, won))
    out = ordered.expanding(bets.withColumn("_g", F.coalesce(step, F.lit(0.0))), group, order, {"_sum": ("sum", "_g")}, inclusive=True)
    return out.withColumn("bankroll", start * F.exp("_sum")).drop("_g", "_sum")


def recalculate_ledger(ledger: DataFrame, group: Sequence[str], order: Sequence[str], start: float) -> DataFrame:
    """Replay given stakes: pnl from odds and result, 0 while pending, and the running balance."""
    settled = ledger.withColumn("pnl", odds.pnl(F.col("stake"), F.col("odds"), F.col("won")))
    out = ordered.expanding(settled, group, order, {"bankroll": ("sum", "pnl")}, inclusive=True)
    return out.withColumn("bankroll", (F.col("bankroll") + F.lit(start).cast(CENTS)).cast(CENTS))


STRATEGY = ("strategy string, min_edge double, frac double, cap double, min_odds double, max_odds double")


def strategy_sweep(bets: DataFrame, season: Sequence[str], order: Sequence[str], strategies: Sequence[tuple],
                   start: float = 100.0) -> DataFrame:
    """Final bankroll of every (strategy, season): a fold over a grid of settings.

    ``strategies`` lists (strategy, min_edge, frac, cap, min_odds, max_odds); they are
    exploded in the row, and bets a strategy does not take are dropped at once. Amounts are
    exact at any size: as text in whole cents (``staked_text``, ``pnl_text``, ``final_text``),
    and as money where a bigint of cents holds them, else null.
    """
    kinds = [p.split() for p in STRATEGY.split(", ")]
    grid = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(s, kinds)]) for s in strategies])
    wide = bets.select("*", F.inline(grid)).filter(
        (F.col("edge") > F.col("min_edge"))
        & (F.col("min_odds").isNull() | (F.col("odds") >= F.col("min_odds")))
        & (F.col("max_odds").isNull() | (F.col("odds") <= F.col("max_odds"))))
    share = odds.kelly_fraction(F.col("model_prob"), F.col("odds"), F.col("frac"), F.col("cap"))
    first = int(round(start * 100))
    prepared = _prepared(wide, share, F.col("odds"), F.col("won")).withColumn(
        "_alone", functools.reduce(lambda x, y: x | y, [F.col(k).isNull() for k in season], F.lit(False)))

    def step(state: tuple, bet: tuple) -> tuple:
        balance, staked, pnl, n, wins = state
        # bets of no season follow no other: each starts anew, and they are summed
        (after,), stake, result = _bet((first if bet[3] else balance,), bet[:3])
        return after, staked + stake, pnl + result, n + 1, wins + (bet[2] == 1)

    def finish(state: tuple) -> tuple:
        after, staked, pnl, n, wins = state
        sums = (staked, pnl, after)
        # Decimal writes integers of any length
        return n, wins, *map(_held, sums), *(str(Decimal(x)) for x in sums)

    outputs = {"bets": "bigint", "wins": "bigint", "staked": "bigint", "pnl": "bigint", "final_bankroll": "bigint",
               "staked_text": "string", "pnl_text": "string", "final_text": "string"}
    ends = ordered_end(prepared, ["strategy", *season], order, ["_share", "_net", "_won", "_alone"], step, outputs, (first, 0, 0, 0, 0), finish)
    return ends.withColumns({n: _dollars(n) for n in ("staked", "pnl", "final_bankroll")})
