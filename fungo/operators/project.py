"""Row-wise operators: filters, fills, differences, reshaping, set operations, top-k."""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from fungo.functions import odds


def _all(conds) -> Column:
    return functools.reduce(operator.and_, conds)


# --- keys -----------------------------------------------------------------

def game_identity(df: DataFrame, day: str, home: str, away: str, number: str, name: str = "game_id") -> DataFrame:
    return df.withColumn(name, F.concat_ws("_", F.date_format(day, "yyyyMMdd"), *[F.col(x).cast("string") for x in (home, away, number)]))


def dedupe_keep(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key, the first or last under a stated order; combines before the shuffle."""
    from fungo.operators import ordered

    return (ordered.first if keep == "first" else ordered.latest)(df, keys, order).select(*df.columns)


# --- filters --------------------------------------------------------------

def clean_game_logs(raw: DataFrame) -> DataFrame:
    """Decided home rows of a schedule page: drop suspended and postponed games, parse 'Apr 5' plus year."""
    day = F.try_to_timestamp(F.concat_ws(" ", F.regexp_extract("Date", r"(\w+ \d+)", 1), F.col("year").cast("string")),
                             F.lit("MMM d yyyy"))
    return (raw.filter((F.col("Home_Away") == "Home") & F.col("W/L").rlike("W|L") & ~F.col("W/L").rlike("(?i)susp|ppd"))
            .withColumn("game_date", F.to_date(day))
            .filter(F.col("game_date").isNotNull())
            .select("game_date", "year", F.col("team").alias("home_team"), F.col("Opp").alias("away_team"),
                    F.col("R").alias("home_runs"), F.col("RA").alias("away_runs"),
                    F.col("W/L").startswith("W").cast("int").alias("home_win")))


def coerce_numeric(col: Column) -> Column:
    """Text to double, anything unreadable (or NaN) to null."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x), x)


def status_filter(df: DataFrame, status: str, scores: Sequence[str]) -> DataFrame:
    done = F.col(status).contains("Final") | F.lower(status).isin("complete", "completed")
    return df.filter(done & _all(F.col(s).isNotNull() for s in scores))


def season_slice(df: DataFrame, season: str, seasons: Sequence[int] | None = None, before: int | None = None,
                 day: str | None = None, until: str | None = None) -> DataFrame:
    if seasons is not None:
        df = df.filter(F.col(season).isin(*seasons))
    if before is not None:
        df = df.filter(F.col(season) < before)
    if until is not None:
        df = df.filter(F.col(day) <= F.lit(until).cast("date"))
    return df


# Accepted sums of both implied probabilities, by the source's era.
VIG_ERA = 2022
VIG_BOUNDS = {"old": (1.01, 1.05), "new": (1.03, 1.13)}


def vig_bounds_filter(df: DataFrame, home_ml: str, away_ml: str, year: Column) -> DataFrame:
    total = odds.overround(F.col(home_ml), F.col(away_ml))
    old = year < VIG_ERA
    lo = F.when(old, VIG_BOUNDS["old"][0]).otherwise(VIG_BOUNDS["new"][0])
    hi = F.when(old, VIG_BOUNDS["old"][1]).otherwise(VIG_BOUNDS["new"][1])
    return df.filter(total.between(lo, hi))


def valid_moneyline_filter(df: DataFrame, *mls: str) -> DataFrame:
    return df.filter(_all(F.abs(m) >= 100 for m in mls))


def bad_quote_fallback(mean: Column, primary: Column) -> Column:
    """A mean price inside (-100, 100) cannot be a price: take the primary book."""
    return F.when((F.abs(mean) < 100) & primary.isNotNull(), primary).otherwise(mean)


def drop_incomplete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(required), how="any")


def notable_transactions(tx: DataFrame, since: str, codes: Sequence[str], teams: DataFrame) -> DataFrame:
    recent = tx.filter((F.col("date") >= F.lit(since).cast("date")) & F.col("type_code").isin(*codes))
    return recent.join(teams, "team", "left_semi")


def period_filter(df: DataFrame, day: str, period: str, today: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """today | 7d | 30d | month | year | custom, relative to a given day."""
    d, now = F.col(day), F.lit(today).cast("date")
    cond = {
        "today": lambda: d == now,
        "7d": lambda: (d > F.date_sub(now, 7)) & (d <= now),
        "30d": lambda: (d > F.date_sub(now, 30)) & (d <= now),
        "month": lambda: F.trunc(d, "month") == F.trunc(now, "month"),
        "year": lambda: F.year(d) == F.year(now),
        "custom": lambda: d.between(F.lit(start).cast("date"), F.lit(end).cast("date")),
    }[period]()
    return df.filter(cond)


# --- fills and differences ------------------------------------------------

ZERO_ENDINGS = ("_diff", "_delta", "_advantage", "_momentum")


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed nulls for absent columns; present ones are cast to the schema."""
    have = set(df.columns)
    extra = [F.col(x) for x in df.columns if x not in schema.fieldNames()]
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema], *extra)


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """First non-null of those names that exist."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None)


def optional_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select(*[w for w in wanted if w in df.columns])


def fill_neutral(df: DataFrame, defaults: Mapping[str, float]) -> DataFrame:
    """Neutral values for known features, 0 for differences, in one projection."""
    def fill(name: str) -> Column:
        value = defaults.get(name, 0.0 if name.endswith(ZERO_ENDINGS) else None)
        return F.col(name) if value is None else F.coalesce(coerce_numeric(F.col(name)), F.lit(float(value))).alias(name)

    return df.select(*[fill(x) for x in df.columns])


def recompute_diffs(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """left - right for every pair whose columns exist; null becomes 0."""
    have = set(df.columns)
    return df.withColumns({n: F.coalesce(F.col(a) - F.col(b), F.lit(0.0)) for n, (a, b) in pairs.items() if {a, b} <= have})


def calendar_features(df: DataFrame, day: str) -> DataFrame:
    return df.withColumns({
        "game_month": F.month(day).cast("double"), "game_day_of_year": F.dayofyear(day).cast("double"),
        "is_early_season": F.month(day).isin(3, 4).cast("double"), "post_2023_rules": (F.year(day) >= 2023).cast("double")})


def select_by_hand(hand: Column, vs_left: Column, vs_right: Column) -> Column:
    return F.when(hand == "L", vs_left).when(hand == "R", vs_right)


# --- set operations and reshaping ----------------------------------------

def symmetric(df: DataFrame, common: Sequence[str], home: Mapping[str, str | Column], away: Mapping[str, str | Column],
              tag: str = "venue") -> DataFrame:
    """One row per side from one row per game, in a single scan."""
    side = lambda cols, label: F.struct(
        F.lit(label).alias(tag), *[(F.col(x) if isinstance(x, str) else x).alias(n) for n, x in cols.items()])
    return df.select(*common, F.inline(F.array(side(home, "home"), side(away, "away"))))


def source_union(frames: Sequence[tuple[DataFrame, Mapping[str, str]]], keys: Sequence[str], order: Sequence[str],
                 keep: str = "last") -> DataFrame:
    """Union of sources after renaming, one row per key."""
    renamed = [f.withColumnsRenamed(dict(m)) for f, m in frames]
    both = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
    return dedupe_keep(both, keys, order, keep)


def key_difference(fetched: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return fetched.join(existing.select(*keys), list(keys), "left_anti")


def key_union(df: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """Distinct values over several columns, one scan."""
    return df.select(F.explode(F.array(*cols)).alias(name)).filter(F.col(name).isNotNull()).distinct()


def pivot_first(df: DataFrame, keys: Sequence[str], label: str, values: Sequence[str], col: str, order: str) -> DataFrame:
    """Long to wide with a given value list; the first value under ``order`` where there are several."""
    cells = [F.min_by(F.when(F.col(label) == v, F.col(col)),
                      F.when((F.col(label) == v) & F.col(col).isNotNull(), F.col(order))).alias(v) for v in values]
    return df.groupBy(*keys).agg(*cells)


def side_orient(df: DataFrame, features: Sequence[str], away_bet: Column) -> DataFrame:
    """Features seen from the bet's side: differences change sign, home_/away_ columns swap."""
    have = set(df.columns)

    def seen(name: str) -> Column:
        twin = name.replace("home_", "away_", 1) if name.startswith("home_") else name.replace("away_", "home_", 1)
        if name.endswith("_diff"):
            return F.when(away_bet, -F.col(name)).otherwise(F.col(name))
        if name.startswith(("home_", "away_")) and twin in have:
            return F.when(away_bet, F.col(twin)).otherwise(F.col(name))
        return F.col(name)

    return df.withColumns({n: seen(n) for n in features})


def unpivot_features(df: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    same = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return same.unpivot(list(ids), list(features), "feature", "value")


# --- top-k ----------------------------------------------------------------

def top_bottom_n(df: DataFrame, col: str, tie: str, n: int) -> DataFrame:
    known = df.filter(F.col(col).isNotNull())
    hot = known.orderBy(F.desc(col), tie).limit(n).withColumn("list", F.lit("hot"))
    cold = known.orderBy(F.asc(col), tie).limit(n).withColumn("list", F.lit("cold"))
    return hot.unionByName(cold)


def quota_topk(df: DataFrame, keys: Sequence[str], score: str, tie: str, eligible: Column,
               share: float = 0.20, least: int = 1, most: int = 3) -> DataFrame:
    """Mark the best rows of each group, max(least, min(most, ceil(share * n))) of them.

    Only the ``most`` best of a group are compared with the quota, found with a
    rank that Spark cuts before the shuffle.
    """
    quota = df.groupBy(*keys).agg(F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.count(F.lit(1)) * share))).cast("int").alias("quota"))
    w = W.partitionBy(*keys).orderBy(F.desc(score), tie)
    best = (df.filter(eligible & F.col(score).isNotNull()).select(*keys, tie, score)
            .withColumn("slate_rank", F.row_number().over(w)).filter(F.col("slate_rank") <= most).drop(score))
    return (df.join(quota, list(keys)).join(best, [*keys, tie], "left")
            .withColumn("selected", F.coalesce(F.col("slate_rank") <= F.col("quota"), F.lit(False))))
