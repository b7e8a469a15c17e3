"""Alerts, streaks, settlement and quote windows over event time. No wall clock is read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor

from fungo.functions import labels, odds
from fungo.operators import decision as d, joins as j
from fungo.sources.versions import VersionedTable
from fungo.streaming import run


def quote_parts(quotes: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Counts and sums per game and event-time window, tumbling or sliding, of one batch of quotes.

    They add up over batches in any order, so files that arrive late or unordered lose
    nothing and no state is kept between batches.
    """
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    grouped = quotes.groupBy(w.alias("w"), "game_key").agg(F.count("price").alias("quotes"), F.sum(F.col("price").cast("decimal(18,8)")).alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "game_key", "quotes", "total")


def merge_quotes(parts: DataFrame) -> DataFrame:
    """Consensus price per game and window from the parts of all batches."""
    summed = parts.groupBy("window_start", "window_end", "game_key").agg(F.sum("quotes").alias("quotes"), F.sum("total").alias("total"))
    return summed.select("window_start", "window_end", "game_key", "quotes", (F.col("total").cast("double") / F.col("quotes")).alias("consensus"))


def time_gate(alerts: DataFrame, first_hour: int = 10, last_hour: int = 23, least_minutes: int = 5) -> DataFrame:
    """Within the active hours, Eastern, and not too close to the start; from the quote's own time."""
    hour = F.hour(F.from_utc_timestamp("ts", "America/New_York"))
    minutes = (F.unix_timestamp("start_ts") - F.unix_timestamp("ts")) / 60
    return alerts.filter((hour >= first_hour) & (hour < last_hour) & (F.col("start_ts").isNull() | (minutes >= least_minutes)))


ALERT_KEY = ("game_date", "alert_type", "home_team", "away_team")


def alert_dedupe(alerts: DataFrame, table: VersionedTable, path: str, keys: Sequence[str] = ALERT_KEY) -> None:
    """One alert per key in ``table``, the one of the smallest event time, whatever order they arrive in.

    No watermark, so nothing is ever too late; a repeated batch changes nothing. The
    table's partition column must be of the alerts.
    """
    run.each_batch(alerts, path, lambda batch, n: table.first_wins(batch, keys, ["ts", *keys]))


def alert_stream(quotes: DataFrame, games: DataFrame, rules: DataFrame, bankroll: float, frac: float = 0.25, cap: float = 0.05,
                 least_stake: float = 0.01, policy: str = "policy", gate: dict | None = None) -> DataFrame:
    """Quotes joined with the day's games and probabilities, reduced to bets the policy allows.

    ``quotes`` streams game_pk, ts and both prices; ``games`` is the static side with
    game_date, teams, p_model, status, starters, lineup flags and start_ts. Emits an
    early alert, and a final one when both lineups are out. ``gate`` holds arguments of
    ``time_gate``, which is applied before anything is computed.
    """
    open_ = ~F.col("status").rlike("Final|Progress|Delayed")
    known = ~labels.unknown_starter(F.col("home_sp")) & ~labels.unknown_starter(F.col("away_sp"))
    rows = quotes.join(games, "game_pk").filter(open_ & known)
    if gate is not None:
        rows = time_gate(rows, **gate)
    rows = rows.filter(odds.overround(F.col("home_ml"), F.col("away_ml")) >= 1.0).withColumn("market", odds.devig(F.col("home_ml"), F.col("away_ml")))
    picked = d.apply_policy(d.choose_side(rows, "p_model", "market", home_win=None), rules, policy=policy).filter("should_bet")
    staked = picked.withColumn("stake", odds.money(odds.kelly_fraction(F.col("model_prob"), F.col("odds"), frac, cap) * F.lit(float(bankroll))))
    staked = staked.filter(F.col("stake") >= least_stake).withColumn("lineup_status", labels.lineup_status(F.col("home_lineup"), F.col("away_lineup")))
    both = F.col("lineup_status") == "both confirmed"
    kinds = F.when(both, F.array(F.lit("early_actionable"), F.lit("final_lineup"))).otherwise(F.array(F.lit("early_actionable")))
    return staked.withColumn("alert_type", F.explode(kinds))


class SliceOfResults(StatefulProcessor):
    """Keeps the results of one team and month, and sends on the runs at both ends of the month.

    A month of one team has few games, so the state of a key is small, and months are
    disjoint in time, so their runs can be joined in any order of arrival.
    """

    def init(self, handle) -> None:
        self.games = handle.getMapState("games", "game_date date, game_pk long", "won boolean")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        for r in rows:
            if r.run_diff is not None:
                self.games.updateValue((r.game_date, r.game_pk), (r.run_diff > 0,))
        won = [w for _, w in sorted((tuple(k), v[0]) for k, v in self.games.iterator())]
        if won:
            tail = next((i for i, w in enumerate(reversed(won)) if w != won[-1]), len(won))
            yield Row(team=key[0], month=key[1], games=len(won), tail=tail, won_last=won[-1])

    def close(self) -> None:
        pass


def month_runs(results: DataFrame) -> DataFrame:
    """Per team and month of a stream of results the number of games and the run that ends it (update mode).

    ``results`` has team, game_date, game_pk and run_diff; rows may come in any order and
    more than once.
    """
    # keyed state of several values needs the store that keeps columns
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    keyed = results.select("team", F.trunc("game_date", "month").alias("month"), "game_date", "game_pk", "run_diff")
    return keyed.groupBy("team", "month").transformWithState(
        SliceOfResults(), "team int, month date, games long, tail long, won_last boolean", "Update", "None")


def streaks_of(months: DataFrame) -> DataFrame:
    """Signed streak per team after its last game, from ``month_runs``.

    A month that is one run joins the run before it. There is a row per team and month.
    """
    w = W.partitionBy("team").orderBy("month")
    back = W.partitionBy("team").orderBy(F.desc("month"))
    breaks = (F.col("tail") < F.col("games")) | F.lag("won_last").over(w).isNull() | (F.lag("won_last").over(w) != F.col("won_last"))
    # the last run reaches back to the newest month that does not join the one before
    rows = months.withColumn("_b", breaks.cast("int")).withColumn("_later", F.coalesce(F.sum("_b").over(back.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = rows.filter("_later = 0").groupBy("team").agg(F.sum("tail").alias("n"), F.max_by("won_last", "month").alias("won"))
    return last.select("team", F.when(F.col("won"), F.col("n")).otherwise(-F.col("n")).cast("long").alias("streak"))


def season_pct(games: DataFrame) -> DataFrame:
    """Running wins and games per team and season of a stream of results (update mode)."""
    return games.groupBy("team", "season").agg(F.count("run_diff").alias("games"), F.count_if(F.col("run_diff") > 0).alias("wins"))


def with_snapshot_pct(running: DataFrame, snapshot: DataFrame, least: int = 10) -> DataFrame:
    """Snapshot totals plus newer live games; null below ``least`` games."""
    both = snapshot.select("team", "season", F.col("games").alias("_g"), F.col("wins").alias("_w")).join(running, ["team", "season"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    n, w = zero("_g") + zero("games"), zero("_w") + zero("wins")
    return both.select("team", "season", n.alias("games"), F.when(n >= least, w / n).alias("season_win_pct"))


def settle_bets(bets: DataFrame, finals: DataFrame, delay: str = "1 day", within: str = "interval 2 days") -> DataFrame:
    """Bets joined with finals that arrive within a bounded time after them, settled in money.

    Later finals are for ``settle_late``, which joins tables and forgets nothing.
    """
    b = bets.withWatermark("bet_ts", delay)
    f = finals.withWatermark("final_ts", delay).withColumnRenamed("game_pk", "_game")
    near = (F.col("game_pk") == F.col("_game")) & (F.col("final_ts") >= F.col("bet_ts")) & (F.col("final_ts") <= F.col("bet_ts") + F.expr(within))
    return _settled(b.join(f, near).drop("_game"))


def settle_late(bets: DataFrame, finals: DataFrame, done: DataFrame) -> DataFrame:
    """Bets of the table that the stream left pending, settled with finals of any age."""
    return _settled(bets.join(done.select("game_pk").distinct(), "game_pk", "left_anti").join(finals, "game_pk"))


def _settled(rows: DataFrame) -> DataFrame:
    won = F.when(F.col("side") == "home", F.col("home_score") > F.col("away_score")).otherwise(F.col("away_score") > F.col("home_score"))
    return rows.withColumn("won", won).withColumn("pnl", odds.pnl(F.col("stake"), F.col("odds"), F.col("won")))


def apply_corrections(table: VersionedTable, batch: DataFrame, keys: Sequence[str], day: str, newest: str, horizon: int = 21) -> None:
    """Replace re-fetched keys in a table; corrections older than the horizon are left out.

    Only partitions with corrections are written, so with a table by month at most three are.
    """
    table.replace_keys(batch.filter(F.col(day) >= F.date_sub(F.lit(newest).cast("date"), horizon)), keys)


def fresh_or_monthly(asks: DataFrame, live: DataFrame, monthly: DataFrame, value: str, days: int = 14) -> DataFrame:
    """A live snapshot if one is at most ``days`` old, else the latest monthly one."""
    now = j.asof_join(asks, live.withColumnsRenamed({value: "_live"}), ["team"], "game_date", "live_date", ["_live"])
    out = j.asof_join(now, monthly, ["team"], "game_date", "snap_date", [value], cell=F.trunc("_at", "month"), source=asks)
    recent = F.datediff("game_date", "live_date_asof") <= days
    return out.withColumn(value, F.when(recent, F.col("_live")).otherwise(F.col(value))).withColumn(
        "source", F.when(recent, "live").when(F.col("snap_date_asof").isNotNull(), "monthly").otherwise("none")).drop("_live", "live_date_asof", "snap_date_asof")
