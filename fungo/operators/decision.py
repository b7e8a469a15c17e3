"""Which side to bet on, whether the policy allows it, and how policies are tuned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fungo.functions import labels, odds
from fungo.operators import ordered

# The rule used where nothing else is known.
FALLBACK_BUCKET, FALLBACK_EDGE = "+130:+170", 0.06
# Tuning grid and limits.
TUNE_THRESHOLDS = (0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.10)
TUNE_MIN_BETS, TUNE_FULL_WEIGHT = 30, 300
SIMULATED_EDGES = (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.10)


def exact_units(x: Column) -> Column:
    """Sum in units of 1e-8, as a whole number that does not depend on how rows are spread over tasks.

    Each value is rounded to a whole number of units and its high and low bits are summed
    apart, so the sums stay in long arithmetic and hold for trillions of rows.
    """
    units = F.floor(x * 100_000_000.0 + 0.5).cast("bigint")
    high, low = F.shiftright(units, 20), units.bitwiseAND(F.lit(1048575).cast("bigint"))
    return F.sum(high).cast("decimal(28,0)") * F.lit(1048576).cast("decimal(8,0)") + F.sum(low).cast("decimal(20,0)")


def exact_sum(x: Column) -> Column:
    """Sum of a double to eight decimals, the same whatever the partitioning."""
    return exact_units(x).cast("double") / 100_000_000.0


def exact_avg(x: Column) -> Column:
    return F.try_divide(exact_sum(x), F.count(x))


def choose_side(df: DataFrame, p: str = "p_model", market: str = "p_market", home_ml: str = "home_ml",
                away_ml: str = "away_ml", home_win: str | None = "home_win") -> DataFrame:
    """The side with the larger edge over the market, home on ties.

    The chosen side is taken out of an array of one, so that later filters work on its
    values and are not rewritten into formulas over the prices.
    """
    edge_home = F.col(p) - F.col(market)
    edge_away = (1 - F.col(p)) - (1 - F.col(market))

    def bet(side: str, prob: Column, price: Column, ml: str, edge: Column, result: int) -> Column:
        won = [(F.col(home_win) == result).alias("won")] if home_win else []
        return F.struct(F.lit(side).alias("side"), prob.alias("model_prob"), price.alias("market_prob"), F.col(ml).alias("odds"), edge.alias("edge"), *won)

    home = bet("home", F.col(p), F.col(market), home_ml, edge_home, 1)
    away = bet("away", 1 - F.col(p), 1 - F.col(market), away_ml, edge_away, 0)
    return df.select("*", F.inline(F.array(F.when(edge_home >= edge_away, home).otherwise(away))))


def resolve_policy_rule(df: DataFrame, rules: DataFrame, bucket: str = "odds_bucket", phase: str = "season_phase") -> DataFrame:
    """Attach ``min_edge`` and ``min_model_prob`` of the most specific rule.

    Precedence: bucket and phase, bucket with any phase, any bucket with the phase,
    any bucket with any phase. ``rules`` has bucket, season_phase, min_edge,
    min_model_prob and position; the first position wins among equal keys. Reduced
    to one row per key it has at most 40 rows, whatever came in.
    """
    keyed = ordered.first(rules, ["bucket", "season_phase"], ["position"], ["min_edge", "min_model_prob"])
    wanted = [(F.col(bucket), F.col(phase)), (F.col(bucket), F.lit("all")), (F.lit("all"), F.col(phase)), (F.lit("all"), F.lit("all"))]
    out = df
    for i, (b, ph) in enumerate(wanted):
        r = keyed.select(F.col("bucket").alias(f"_b{i}"), F.col("season_phase").alias(f"_f{i}"),
                         F.struct("min_edge", "min_model_prob").alias(f"_r{i}"))
        out = out.join(F.broadcast(r), (b == F.col(f"_b{i}")) & (ph == F.col(f"_f{i}")), "left").drop(f"_b{i}", f"_f{i}")
    rule = F.when(F.col(bucket).isNotNull(), F.coalesce(*[F.col(f"_r{i}") for i in range(4)]))
    return out.withColumns({"min_edge": rule["min_edge"], "min_model_prob": rule["min_model_prob"]}).drop(*[f"_r{i}" for i in range(4)])


def whole_percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("bigint").cast("string"), F.lit("%"))


def evaluate_candidate(df: DataFrame, policy: str = "policy") -> DataFrame:
    """``should_bet`` and the reason, from a candidate with its rule attached."""
    edge, bucket, least = F.col("edge"), F.col("odds_bucket"), F.col("min_edge")
    low_prob = F.coalesce(F.col("model_prob") < F.col("min_model_prob"), F.lit(False))
    reason = (F.when(bucket.isNull(), F.lit("missing odds"))
              .when(least.isNull(), F.concat(bucket, F.lit(f" excluded by {policy}")))
              .when(edge.isNull(), F.lit("missing edge"))
              .when(low_prob, F.concat(F.lit("model prob < "), whole_percent(F.col("min_model_prob"))))
              .when(edge > least, F.concat(F.lit(f"{policy}: "), bucket, F.lit(" edge > "), whole_percent(least)))
              .otherwise(F.concat(F.lit("edge <= "), whole_percent(least), F.lit(" threshold"))))
    passed = bucket.isNotNull() & least.isNotNull() & edge.isNotNull() & ~low_prob & (edge > least)
    return df.withColumns({"should_bet": F.coalesce(passed, F.lit(False)), "policy_reason": reason})


def apply_policy(df: DataFrame, rules: DataFrame, day: str = "game_date", policy: str = "policy") -> DataFrame:
    """Candidates with bucket, phase, rule, decision and reason."""
    keyed = df.withColumns({"odds_bucket": odds.odds_bucket(F.col("odds")), "season_phase": labels.season_phase(F.col(day))})
    return evaluate_candidate(resolve_policy_rule(keyed, rules), policy)


def tune_thresholds(bets: DataFrame, season: str = "season", thresholds: Sequence[float] = TUNE_THRESHOLDS,
                    min_bets: int = TUNE_MIN_BETS) -> DataFrame:
    """Best edge threshold per (test season, odds bucket) from earlier seasons only.

    Rows are read and summed once, to a row per season and bucket with a sum per
    threshold. Earlier seasons are a frame over those few rows, every season having a row
    for every bucket; the best threshold is picked inside the row.
    """
    known = bets.dropna(subset=["edge", "odds", "won", "odds_bucket"])
    profit = odds.flat_profit(F.col("odds"), F.col("won"))
    over = [F.col("edge") > t for t in thresholds]
    sums = known.groupBy(F.col(season).alias("test_season"), "odds_bucket").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(o).alias(f"n{i}") for i, o in enumerate(over)],
        *[F.coalesce(exact_units(F.when(o, profit)), F.lit(0).cast("decimal(38,0)")).alias(f"pnl{i}") for i, o in enumerate(over)])
    names = [c for c in sums.columns if c not in ("test_season", "odds_bucket")]
    by_season = sums.groupBy("test_season").agg(F.map_from_entries(F.collect_list(F.struct("odds_bucket", F.struct(*names)))).alias("_of"))
    dense = by_season.select("test_season", "_of", F.explode(F.array(*[F.lit(b) for b, _, _ in odds.ODDS_BUCKETS])).alias("odds_bucket"))
    own = F.try_element_at("_of", F.col("odds_bucket"))
    dense = dense.select("test_season", "odds_bucket", *[F.coalesce(own[n], F.lit(0)).alias(n) for n in names])
    w = W.partitionBy("odds_bucket").orderBy("test_season").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    prior = dense.select("test_season", "odds_bucket", F.count("test_season").over(w).alias("total_years"), *[zero(F.sum(n).over(w)).alias(n) for n in names],
                         *[zero(F.sum((F.col(f"pnl{i}") > 0).cast("int")).over(w)).alias(f"good{i}") for i in range(len(thresholds))])

    def candidate(i: int, threshold: float) -> Column:
        n, roi = F.col(f"n{i}"), F.try_divide(F.col(f"pnl{i}").cast("double") / 100_000_000.0, F.col(f"n{i}"))
        fit = (n >= min_bets) & (roi > 0) & (F.col(f"good{i}") >= F.greatest(F.lit(1), F.col("total_years") - 1))
        # the best score wins, then the lower threshold
        return F.when(fit, F.struct((roi * F.least(F.lit(1.0), n / TUNE_FULL_WEIGHT)).alias("score"), F.lit(-float(threshold)).alias("low"), n.alias("n"), roi.alias("roi"),
                                    F.col(f"good{i}").alias("good")))

    out = prior.withColumn("_b", F.array_max(F.array(*[candidate(i, t) for i, t in enumerate(thresholds)])))
    fallback = (F.col("total_years") == 0) & (F.col("odds_bucket") == FALLBACK_BUCKET)
    reason = (F.when(F.col("_b").isNotNull(), "selected").when(fallback, "bootstrap: no prior seasons")
              .when(F.col("total_years") == 0, "no prior seasons").otherwise("no profitable threshold found"))
    return out.select(
        "test_season", "odds_bucket", F.when(fallback, F.lit(FALLBACK_EDGE)).otherwise(-F.col("_b.low")).alias("edge_threshold"),
        F.coalesce("_b.n", "n").alias("prior_bets"), F.col("_b.roi").alias("prior_flat_roi"), F.col("_b.good").alias("profitable_years"), "total_years",
        F.col("_b.score").alias("score"), reason.alias("reason"))


def tuned_rules(report: DataFrame) -> DataFrame:
    """Rules valid for one season each: season, bucket, min_edge; the fallback rule where none was selected."""
    chosen = F.col("reason") == "selected"
    rules = F.array_compact(F.collect_list(F.when(chosen, F.struct(F.col("odds_bucket").alias("bucket"), F.col("edge_threshold").alias("min_edge")))))
    fallback = F.array(F.struct(F.lit(FALLBACK_BUCKET).alias("bucket"), F.lit(FALLBACK_EDGE).alias("min_edge")))
    by_season = report.groupBy(F.col("test_season").alias("season")).agg(rules.alias("_r"))
    return by_season.select("season", F.inline(F.when(F.size("_r") > 0, F.col("_r")).otherwise(fallback)))


def apply_seasonal_rules(df: DataFrame, rules: DataFrame, season: str = "season", policy: str = "walk-forward") -> DataFrame:
    """Decisions of every candidate by the rules of its own season; a season has at most a rule per bucket."""
    keyed = rules.select(F.col("season").alias(season), F.col("bucket").alias("odds_bucket"), "min_edge")
    return evaluate_candidate(df.join(keyed, [season, "odds_bucket"], "left").withColumn("min_model_prob", F.lit(0.0)), policy)


def walk_forward_rules(bets: DataFrame, season: str = "season") -> DataFrame:
    """Out-of-sample candidates with the decision of rules that were tuned on the seasons before each one."""
    return apply_seasonal_rules(bets, tuned_rules(tune_thresholds(bets, season)), season)


def season_summary(decided: DataFrame, season: str = "season") -> DataFrame:
    """Per season the candidates, bets, wins, mean edge and flat return of the bets."""
    bet = F.col("should_bet") & F.col("won").isNotNull()
    n = F.count_if(bet)
    per = lambda x: F.try_divide(exact_units(F.when(bet, x)).cast("double") / 100_000_000.0, n)
    return decided.groupBy(season).agg(
        F.count(F.lit(1)).alias("candidates"), n.alias("bets"), F.count_if(bet & F.col("won")).alias("wins"), per(F.col("edge")).alias("avg_edge"),
        per(odds.flat_profit(F.col("odds"), F.col("won"))).alias("flat_roi"))


def threshold_simulation(bets: DataFrame, edge: str = "edge", raw: str | None = None,
                         thresholds: Sequence[float] = SIMULATED_EDGES) -> DataFrame:
    """Bets, win rate, mean edges and flat return at each minimum edge; thresholds without bets stay in."""
    raw = raw or edge
    known = bets.dropna(subset=[edge, "won", "odds"])
    profit = odds.flat_profit(F.col("odds"), F.col("won"))

    def at(threshold: float) -> Column:
        on = F.col(edge) >= threshold
        units = lambda x: exact_units(F.when(on, x))
        return F.struct(F.lit(float(threshold)).alias("min_edge"), F.count_if(on).alias("bets"), F.count_if(on & F.col("won")).alias("wins"),
                        units(F.col(raw)).alias("raw"), units(F.col(edge)).alias("cal"), units(profit).alias("pnl"))

    rows = known.agg(F.array(*[at(t) for t in thresholds]).alias("_r")).select(F.inline("_r"))
    per = lambda x: F.try_divide(F.col(x).cast("double") / 100_000_000.0, F.col("bets"))
    return rows.select("min_edge", "bets", F.try_divide(F.col("wins").cast("double"), F.col("bets")).alias("win_rate"), per("raw").alias("avg_raw_edge"),
                       per("cal").alias("avg_calibrated_edge"), per("pnl").alias("flat_stake_roi"))


def closing_line_value(df: DataFrame, close_probs: Sequence[str], close_home: Sequence[str], close_away: Sequence[str]) -> DataFrame:
    """Closing probability of the chosen side minus the probability taken."""
    from fungo.operators.project import first_present

    home = F.coalesce(first_present(df, close_probs), odds.devig(first_present(df, close_home), first_present(df, close_away)))
    close = F.when(F.col("side") == "home", home).when(F.col("side") == "away", 1 - home)
    return df.withColumns({"close_prob": close, "clv_prob": close - F.col("market_prob")})


def bet_context(df: DataFrame, starters: DataFrame, on: Sequence[str]) -> DataFrame:
    """Favourite flag, own and opposing starter with hand, from the bet's side."""
    both = df.join(starters, list(on), "left")
    home = F.col("side") == "home"
    own = lambda x: F.when(home, F.col(f"home_{x}")).when(F.col("side") == "away", F.col(f"away_{x}"))
    opp = lambda x: F.when(home, F.col(f"away_{x}")).when(F.col("side") == "away", F.col(f"home_{x}"))
    return both.withColumns({"is_favorite": F.col("odds") < 0, "sp_name": own("sp_name"), "opp_sp_name": opp("sp_name"),
                             "sp_throws": own("sp_throws"), "opp_sp_throws": opp("sp_throws")})


def slate_ranking(df: DataFrame, slate: Sequence[str], tie: str, bankroll: float, frac: float = 0.25, cap: float = 0.10) -> DataFrame:
    """The best picks of each slate by expected return, with stake and payout."""
    from fungo.operators.project import quota_topk

    ranked = quota_topk(df, slate, "expected_roi", tie, F.col("has_edge"))
    share = odds.kelly_fraction(F.coalesce("quality_prob", "model_prob"), F.col("odds"), frac, cap)
    zero = F.lit(0).cast("decimal(18,2)")
    stake = F.when(F.col("selected"), odds.money(share * F.lit(float(bankroll)))).otherwise(zero)
    out = ranked.withColumn("stake", stake)
    win = out["stake"] + odds.pnl(out["stake"], F.col("odds"), F.lit(True))
    reason = F.when(~F.col("selected") & F.col("has_edge"), F.concat(F.lit("outside top "), F.col("quota").cast("string"), F.lit(" slate-ranked picks")))
    return out.withColumns({"to_win": F.when(F.col("selected"), win).otherwise(zero), "slate_reason": reason})


def grade_predictions(log: DataFrame, finals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fill scores and correctness of ungraded predictions from finals; graded rows stay as they are."""
    f = finals.filter(F.col("home_score").isNotNull() & F.col("away_score").isNotNull()).select(
        *keys, F.col("home_score").alias("_h"), F.col("away_score").alias("_a"))
    out = log.join(f, list(keys), "left")
    open_ = F.col("home_win").isNull() & F.col("_h").isNotNull()
    win = (F.col("_h") > F.col("_a")).cast("int")
    return out.withColumns({
        "home_score": F.when(open_, F.col("_h")).otherwise(F.col("home_score")),
        "away_score": F.when(open_, F.col("_a")).otherwise(F.col("away_score")),
        "model_correct": F.when(open_, (F.col("p_model") > 0.5) == (win == 1)).otherwise(F.col("model_correct")),
        "home_win": F.when(open_, win).otherwise(F.col("home_win")),
    }).drop("_h", "_a")
