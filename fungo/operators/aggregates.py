"""Grouped aggregates, bins, exact quantiles and report families."""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fungo.operators import ordered
from fungo.operators.decision import exact_avg, exact_sum, exact_units

# Report bins, closed on the left.
EDGE_BINS = (("<=0%", -math.inf, 0.0), ("0-1%", 0.0, 0.01), ("1-2%", 0.01, 0.02), ("2-3%", 0.02, 0.03),
             ("3-5%", 0.03, 0.05), ("5-8%", 0.05, 0.08), ("8%+", 0.08, math.inf))
CLV_BINS = (("<-3%", -math.inf, -0.03), ("-3:-1%", -0.03, -0.01), ("-1:0%", -0.01, 0.0), ("0:1%", 0.0, 0.01),
            ("1:3%", 0.01, 0.03), ("3%+", 0.03, math.inf))


# --- simple groups --------------------------------------------------------

def weighted_mean(df: DataFrame, keys: Sequence[str], values: Sequence[str], weight: str, floor: float = 1.0) -> DataFrame:
    """Weighted means over non-null values; weights below ``floor`` count as ``floor``."""
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(floor)), F.lit(floor))
    means = [F.try_divide(exact_sum(F.col(v) * w), exact_sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*means)


def pitch_mix_weighted(df: DataFrame, keys: Sequence[str], rate: str, pitches: str) -> DataFrame:
    """Rate over all pitch types weighted by pitch count; a rate above 1 is a percent."""
    out = weighted_mean(df, keys, [rate], pitches)
    return out.withColumn(rate, F.when(F.col(rate) > 1, F.col(rate) / 100).otherwise(F.col(rate)))


def ratio_of_sums(df: DataFrame, keys: Sequence[str], ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.try_divide(F.sum(a).cast("double"), F.sum(b)).alias(n) for n, (a, b) in ratios.items()])


def park_factor(games: DataFrame, seasons: int = 3) -> DataFrame:
    """Runs per game at home over runs per game away, averaged over the team's earlier seasons."""
    sides = F.array(F.struct(F.col("home_team").alias("team"), F.lit(True).alias("here")), F.struct(F.col("away_team").alias("team"), F.lit(False).alias("here")))
    rows = games.select("season", (F.col("home_runs") + F.col("away_runs")).alias("runs"), F.inline(sides))
    rate = rows.groupBy("team", "season").agg(F.avg(F.when(F.col("here"), F.col("runs"))).alias("_home"), F.avg(F.when(~F.col("here"), F.col("runs"))).alias("_away"),
                                              F.count_if("here").alias("_n"), F.count_if(~F.col("here")).alias("_m")).filter("_n > 0 and _m > 0")
    raw = rate.select("team", "season", F.try_divide("_home", "_away").alias("season_factor"))
    # one row per team and season
    w = W.partitionBy("team").orderBy("season").rowsBetween(-seasons, -1)
    return raw.withColumn("park_factor", F.avg("season_factor").over(w))


def pythagorean_pct(team_games: DataFrame) -> DataFrame:
    s, a = F.sum("rf").cast("double"), F.sum("ra").cast("double")
    return team_games.groupBy("team", "season").agg(F.try_divide(s * s, s * s + a * a).alias("pyth_pct"))


def league_average(appearances: DataFrame) -> DataFrame:
    """Mean total runs per game and season, from appearance rows."""
    per_game = appearances.groupBy("game_pk", "season").agg(F.sum("runs_allowed").alias("runs"))
    return per_game.groupBy("season").agg(F.avg("runs").alias("league_runs"))


def median(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Exact medians of several columns per key, in one pass."""
    from fungo.operators.project import unpivot_features

    long = unpivot_features(df, keys, cols)
    mid = exact_quantiles(long, [*keys, "feature"], "value", {"median": 0.5})
    return mid.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(c) for c in cols])


def sum_player_value(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    both = functools.reduce(DataFrame.unionByName, [s.select(*keys, value) for s in sources])
    return both.groupBy(*keys).agg(F.sum(value).alias(value))


def lineup_mean(df: DataFrame, keys: Sequence[str], slots: str, confirmed_at: int = 8, size: int = 9) -> DataFrame:
    """Mean over the first nine batters' values and whether the lineup is out."""
    people = df.select(*keys, F.size(slots).alias("_n"), F.explode_outer(F.slice(slots, 1, size)).alias("_v"))
    return people.groupBy(*keys).agg(exact_avg(F.col("_v")).alias("lineup_value"), F.count("_v").alias("known_batters"),
                                     (F.max("_n") >= confirmed_at).alias("confirmed"))


# --- bins -----------------------------------------------------------------

def bin_label(col: Column, bins: Sequence[tuple[str, float, float]], closed: str = "left") -> Column:
    """Label of the bin a value falls in, by the inner edges only."""
    label = None
    for name, _, hi in bins:
        if math.isinf(hi):
            continue
        test = (col < hi) if closed == "left" else (col <= hi)
        label = F.when(test, name) if label is None else label.when(test, name)
    last, _, top = bins[-1]
    out = label.when(col.isNotNull(), last) if math.isinf(top) else label
    bottom = bins[0][1]
    if math.isinf(bottom):
        return out
    return F.when((col >= bottom) if closed == "left" else (col > bottom), out)


def with_empty_bins(report: DataFrame, column: str, bins: Sequence[tuple[str, float, float]], counts: Sequence[str]) -> DataFrame:
    """One row per bin in order, also for bins without rows (their counts are 0)."""
    dim = report.sparkSession.createDataFrame([(b, i) for i, (b, _, _) in enumerate(bins)], f"{column} string, ordinal int")
    out = F.broadcast(dim).join(report, column, "left")
    return out.withColumns({n: F.coalesce(n, F.lit(0)) for n in counts})


def equal_bins(lo: float, hi: float, n: int) -> list[tuple[str, float, float]]:
    """n bins of equal width with decimal edges, the last one closed at the top."""
    edges = [round(lo + (hi - lo) * i / n, 10) for i in range(n + 1)]
    out = [(f"[{a:.2f}, {b:.2f})", a, b) for a, b in zip(edges, edges[1:])]
    name, a, _ = out[-1]
    out[-1] = (name[:-1] + "]", a, math.inf)
    return out


# --- exact quantiles ------------------------------------------------------

def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str, probs: Mapping[str, float], accuracy: int = 20_000,
                    shift: Mapping[str, int] | None = None) -> DataFrame:
    """Exact interpolated quantiles per key, without sorting or hashing a whole key in one task.

    ``shift`` moves a name to a whole rank: floor(n * p) plus the shift, null outside
    the data.

    A mergeable sketch gives, per key and probability, two values that surround the
    quantile. Rows below the lower one are only counted; rows between them, a few
    per ten thousand, are counted by value and searched for the wanted ranks. The table of
    bounds, a row per key, is broadcast: keys are features, seasons or teams.
    """
    if not keys:
        whole = df.withColumn("_all", F.lit(1))
        return exact_quantiles(whole, ["_all"], col, probs, accuracy, shift).drop("_all")
    keys = list(keys)
    v = F.col(col).cast("double")
    rows = df.filter(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("_v"))
    margin = 4.0 / accuracy
    near = [x for p in probs.values() for x in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", near, accuracy).alias("_q"))
    at = [F.struct(F.lit(name).alias("_name"), F.lit(float(p)).alias("_p"), F.col("_q")[2 * i].alias("_lo"), F.col("_q")[2 * i + 1].alias("_hi"))
          for i, (name, p) in enumerate(probs.items())]
    bands = sketch.select(*keys, "_n", F.inline(F.array(*at)))
    # a small key is searched whole: at most ``accuracy`` values
    small = F.col("_n") <= accuracy
    bands = bands.withColumns({"_lo": F.when(small, F.lit(-math.inf)).otherwise(F.col("_lo")), "_hi": F.when(small, F.lit(math.inf)).otherwise(F.col("_hi"))})
    packed = bands.groupBy(*keys).agg(F.collect_list(F.struct("_name", "_p", "_n", "_lo", "_hi")).alias("_bands"))
    # a row per key against all rows of the key: broadcast, so that rows stay where they are and no task sorts a key
    hits = rows.join(F.broadcast(packed), keys).select(*keys, "_v", F.inline("_bands"))
    counted = (hits.filter(F.col("_v") <= F.col("_hi"))
               .withColumn("_w", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")))
               .groupBy(*keys, "_name", "_p", "_n", "_w").agg(F.count(F.lit(1)).alias("_c")))
    w = W.partitionBy(*keys, "_name").orderBy(F.asc_nulls_first("_w")).rowsBetween(W.unboundedPreceding, 0)
    cum = counted.withColumn("_cum", F.sum("_c").over(w))
    spot = (F.col("_n") - 1) * F.col("_p")
    for name, by in (shift or {}).items():
        rank_at = F.floor(F.col("_n") * F.col("_p")) + by
        spot = F.when(F.col("_name") != name, spot).when((rank_at >= 0) & (rank_at < F.col("_n")), rank_at)
    rank = lambda f: F.min(F.when(F.col("_cum") >= f(spot) + 1, F.col("_w")))
    found = cum.groupBy(*keys, "_name", "_p", "_n").agg(rank(F.floor).alias("_a"), rank(F.ceil).alias("_b"))
    frac = spot - F.floor(spot)
    value = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * frac)
    wide = [F.max(F.when(F.col("_name") == name, value)).alias(name) for name in probs]
    return found.groupBy(*keys).agg(*wide)


TERCILES = ("low", "mid", "high")


def tercile_bins(df: DataFrame, keys: Sequence[str], value: str, least: int = 30, distinct: int = 3) -> DataFrame:
    """low / mid / high by exact terciles of the key, right-closed.

    Null where the key has fewer than ``least`` values or ``distinct`` different
    ones, or where edges coincide.
    """
    keys = list(keys)
    edges = exact_quantiles(df, keys, value, {"_t0": 0.0, "_t1": 1 / 3, "_t2": 2 / 3, "_t3": 1.0})
    sizes = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
             .groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d")))
    v = F.col(value)
    distinct_edges = (F.col("_t0") < F.col("_t1")) & (F.col("_t1") < F.col("_t2")) & (F.col("_t2") < F.col("_t3"))
    usable = (F.col("_n") >= least) & (F.col("_d") >= distinct) & distinct_edges & v.isNotNull()
    label = F.when(v <= F.col("_t1"), TERCILES[0]).when(v <= F.col("_t2"), TERCILES[1]).otherwise(TERCILES[2])
    return (df.join(F.broadcast(edges.join(sizes, keys)), keys, "left").withColumn("bucket", F.when(usable, label))
            .drop("_t0", "_t1", "_t2", "_t3", "_n", "_d"))


# --- reports --------------------------------------------------------------

def bet_metrics(clv: bool = True) -> list[Column]:
    """Betting summary of candidates: columns edge, stake, won, model_prob, market_prob, odds, pnl, clv_prob."""
    bet = F.col("stake") > 0
    only = lambda c: F.when(bet, F.col(c))
    n = F.count_if(bet)
    staked, pnl = F.coalesce(F.sum(only("stake")), F.lit(0)).cast("double"), F.coalesce(F.sum(only("pnl")), F.lit(0)).cast("double")
    candidates = F.count("edge")
    out = [
        candidates.alias("candidate_games"), n.alias("bets"), F.try_divide(n, candidates).alias("bet_rate"),
        F.count_if(bet & F.col("won")).alias("wins"), F.try_divide(F.count_if(bet & F.col("won")), n).alias("win_rate"),
        exact_avg(only("edge")).alias("avg_edge"), exact_avg(only("model_prob")).alias("avg_model_prob"),
        exact_avg(only("market_prob")).alias("avg_market_prob"), exact_avg(only("odds")).alias("avg_odds"),
        staked.alias("staked"), pnl.alias("pnl"), F.when(staked > 0, pnl / staked).alias("roi"),
    ]
    return out + ([exact_avg(only("clv_prob")).alias("avg_clv_prob")] if clv else [])


def calibration_metrics() -> list[Column]:
    """Predicted against actual: columns win_prob, won (0/1)."""
    p, y = exact_avg(F.col("win_prob")), F.avg("won")
    err = y - p
    gap = F.col("win_prob") - F.col("won")
    return [
        F.count(F.lit(1)).alias("games"), p.alias("avg_pred_prob"), y.alias("actual_win_rate"), err.alias("calibration_error"),
        F.abs(err).alias("abs_calibration_error"),
        F.when(err > 0, "underconfident").when(err < 0, "overconfident").otherwise("calibrated").alias("direction"),
        exact_avg(gap * gap).alias("brier"),
    ]


def report(df: DataFrame, dims: Sequence[Sequence[str]], metrics: Sequence[Column]) -> DataFrame:
    """The same metrics by several dimensions in one pass.

    ``dims`` lists column sets, the empty set being the total. Rows carry the
    dimension's name and its values joined by '|'.
    """
    cols = list(dict.fromkeys(c for d in dims for c in d))
    text = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("unknown")) for c in cols})
    grouped = text.groupingSets([[F.col(c) for c in d] for d in dims], *[F.col(c) for c in cols])
    out = grouped.agg(*metrics, *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    names = F.concat_ws("|", *[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in cols])
    values = F.concat_ws("|", *[F.when(F.col(f"_g_{c}") == 0, F.col(c)) for c in cols])
    kept = [c for c in out.columns if c not in cols and not c.startswith("_g_")]
    return out.select(F.when(names == "", "total").otherwise(names).alias("dimension"), values.alias("value"), *kept)


def feature_roi(bets: DataFrame, ids: Sequence[str], features: Sequence[str], away_bet: Column) -> DataFrame:
    """Return by (feature, tercile) of side-oriented feature values; one job for all features."""
    from fungo.operators.project import side_orient, unpivot_features

    keep = [*ids, "stake", "pnl", "won"]
    long = unpivot_features(side_orient(bets, features, away_bet).select(*keep, *features), keep, features)
    binned = tercile_bins(long, ["feature"], "value").filter(F.col("bucket").isNotNull())
    staked, pnl = F.sum("stake").cast("double"), F.sum("pnl").cast("double")
    return binned.groupBy("feature", "bucket").agg(
        F.count(F.lit(1)).alias("bets"), F.count_if("won").alias("wins"), exact_avg(F.col("value")).alias("avg_value"),
        staked.alias("staked"), pnl.alias("pnl"), F.when(staked > 0, pnl / staked).alias("roi"))


def best_worst_bucket(by_bucket: DataFrame, least: int = 8) -> DataFrame:
    """Best and worst bucket of each feature, the spread, and high minus low."""
    big = by_bucket.filter((F.col("bets") >= least) & F.col("roi").isNotNull())
    rank = F.when(F.col("bucket") == "high", 0).when(F.col("bucket") == "low", 1).otherwise(2)
    best = F.max_by(F.struct("bucket", "roi", "bets"), F.struct("roi", -rank))
    worst = F.min_by(F.struct("bucket", "roi", "bets"), F.struct("roi", rank))
    roi_of = lambda b: F.max(F.when(F.col("bucket") == b, F.col("roi")))
    out = big.groupBy("feature").agg(best.alias("b"), worst.alias("w"), (roi_of("high") - roi_of("low")).alias("high_minus_low_roi"))
    pick = lambda s, n: [F.col(f"{s}.bucket").alias(f"{n}_bucket"), F.col(f"{s}.roi").alias(f"{n}_roi"), F.col(f"{s}.bets").alias(f"{n}_bets")]
    return out.select("feature", *pick("b", "best"), *pick("w", "worst"), (F.col("b.roi") - F.col("w.roi")).alias("roi_spread"), "high_minus_low_roi")


def coverage_report(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[
        (F.count(c) / F.count(F.lit(1))).alias(f"{c}_rate") for c in cols])


def coverage_gaps(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows that lack any of ``cols``, with the names of those they lack; the list behind ``coverage_report``."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return df.select(*keys, *cols, F.array_join(lacking, ",").alias("missing")).filter(F.col("missing") != "")


def year_macro_average(by_year: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unweighted mean over years of per-year metrics."""
    return by_year.groupBy(*keys).agg(F.sum("games").alias("games"), *[exact_avg(F.col(m)).alias(f"avg_{m}") for m in metrics])


def profitable_years(bets: DataFrame, keys: Sequence[str], season: str, profit: Column) -> DataFrame:
    per = bets.groupBy(*keys, season).agg(exact_units(profit).alias("_p"))
    return per.groupBy(*keys).agg(F.count_if(F.col("_p") > 0).alias("profitable_years"), F.count(F.lit(1)).alias("total_years"))


def consensus_price(quotes: DataFrame, keys: Sequence[str], price: str, order: Sequence[str]) -> DataFrame:
    """Mean, opening and closing price over books, each book's first and last quote counting for open and close."""
    per_book = quotes.groupBy(*keys, "book").agg(F.min_by(price, F.struct(*order)).alias("_open"), F.max_by(price, F.struct(*order)).alias("_close"),
                                                 exact_sum(F.col(price)).alias("_s"), F.count(price).alias("_n"))
    r = lambda c: F.floor(c + 0.5).cast("bigint")
    return per_book.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("books"), r(exact_sum(F.col("_s")) / F.sum("_n")).alias("consensus"),
        r(exact_avg(F.col("_open"))).alias("open_price"), r(exact_avg(F.col("_close"))).alias("close_price"))


def season_record(ledger: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Bets, wins, pending, staked, pnl, return and last balance per period."""
    n, wins, lost = F.count_if(F.col("stake") > 0), F.count_if("won"), F.count_if(~F.col("won"))
    staked, pnl = F.sum("stake").cast("double"), F.sum("pnl").cast("double")
    return ledger.groupBy(*keys).agg(
        n.alias("bets"), wins.alias("wins"), F.count_if(F.col("won").isNull()).alias("pending"),
        F.try_divide(wins, wins + lost).alias("win_pct"), staked.alias("staked"), pnl.alias("pnl"),
        F.when(staked > 0, pnl / staked).alias("roi"), F.max_by("bankroll", F.struct(*order)).cast("double").alias("final_bankroll"))
