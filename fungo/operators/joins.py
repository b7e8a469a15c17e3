"""Joins with a point-in-time or fallback meaning.

No side is broadcast by hint unless its size is fixed by construction. Spark
broadcasts other small sides itself from their measured size, and its adaptive
skew join splits large keys of the rest.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from fungo.operators import ordered


def game_key_join(left: DataFrame, right: DataFrame, day: str = "game_date", home: str = "home_team",
                  away: str = "away_team", number: str = "game_number") -> DataFrame:
    """Left join on the game key; the game number belongs to it whenever both sides have it."""
    on = [day, home, away] + ([number] if number in left.columns and number in right.columns else [])
    return left.join(right, on, "left")


def prior_season_join(fact: DataFrame, dim: DataFrame, keys: Sequence[str], season: str = "season", lag: int = 1) -> DataFrame:
    """Attach a season table's row of ``lag`` seasons earlier."""
    return fact.join(dim.withColumn(season, F.col(season) + lag), [*keys, season], "left")


def two_sided_dim_join(fact: DataFrame, dim: DataFrame, key: str, on: Sequence[str] = (), sides=("home", "away")) -> DataFrame:
    """Attach one dimension for both teams of a game: ``home_x`` and ``away_x``."""
    values = [c for c in dim.columns if c != key and c not in on]
    for s in sides:
        d = dim.select(F.col(key).alias(f"{s}_{key}"), *on, *[F.col(v).alias(f"{s}_{v}") for v in values])
        fact = fact.join(d, [f"{s}_{key}", *on], "left")
    return fact


def dict_lookup_join(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, prefix: str = "") -> DataFrame:
    """Attach a constant dimension (one row per team, fixed size)."""
    d = dim.select(F.col(dim_key).alias(key), *[F.col(c).alias(prefix + c) for c in dim.columns if c != dim_key])
    return fact.join(F.broadcast(d), key, "left")


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str,
              values: Sequence[str], inclusive: bool = True, cell: Column | None = None,
              right_tie: Sequence[str] = (), source: DataFrame | None = None) -> DataFrame:
    """Latest ``right`` row at or before ``left_on`` (before, if not ``inclusive``).

    Works on distinct (key, time) points of both sides, so rows that share a point
    are searched once, and carries the last value across cells of the time axis
    instead of windowing a whole key. ``cell`` is a coarse, never decreasing
    function of ``_at``, the default being its day. ``right_tie`` orders right rows
    that share a point. ``source`` names an earlier frame of a chain with the same
    points, so that ``left`` itself is computed once.
    """
    row = F.struct(F.col(right_on).alias("_asof"), *values)
    snaps = (right.groupBy(*by, F.col(right_on).alias("_at"))
             .agg(F.max_by(row, F.struct(right_on, *right_tie)).alias("_row")))
    asked = (left if source is None else source).select(*by, F.col(left_on).alias("_at")).distinct()
    first, second = (0, 1) if inclusive else (1, 0)
    points = (snaps.withColumn("_kind", F.lit(first))
              .unionByName(asked.withColumn("_kind", F.lit(second)), allowMissingColumns=True)
              .withColumn("_cell", F.to_date("_at") if cell is None else cell))
    found = ordered.expanding(points, by, ["_at", "_kind"], {"_hit": ("last", "_row")}, cell="_cell")
    found = found.filter(F.col("_kind") == second).select(*by, F.col("_at").alias(left_on), "_hit")
    out = left.join(found, [*by, left_on], "left")
    return out.select(*left.columns, F.col("_hit._asof").alias(f"{right_on}_asof"), *[F.col(f"_hit.{v}") for v in values])


class Source(NamedTuple):
    """One right side of ``asof_union``: the latest ``values`` before an ask, or at it if ``inclusive``."""

    rows: DataFrame
    at: str
    values: Sequence[str]
    inclusive: bool = True
    tie: Sequence[str] = ()


def asof_union(left: DataFrame, by: Sequence[str], left_on: str, sources: Mapping[str, Source],
               sums: tuple[DataFrame, str, int] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """As-of joins with several right sides at once, all by the same keys and days.

    All points of time, asked and known, are one frame that is dealt once and carried once;
    ``left`` gets a struct of values and ``_asof`` per source. ``sums`` (rows, column, n)
    adds ``{column}_sum``, the sum over the n days before ``left_on`` by rows' ``left_on``:
    a row is added to the running sum on its day and taken off n days later, so rows do
    not depend on n. The column must be of an exact type.
    ``asked`` is an earlier frame of a chain with the same keys and days as ``left``.
    """
    at = F.col(left_on)
    asks = (left if asked is None else asked).select(*by, at.alias("_at"))
    points, aggs, hits = asks.withColumn("_kind", F.lit(1)), [], {}
    for name, src in sources.items():
        row = F.struct(F.col(src.at).alias("_asof"), *src.values)
        tied = F.struct(F.struct(F.col(src.at), *src.tie).alias("tie"), row.alias("row"))
        known = src.rows.select(*by, F.col(src.at).alias("_at"), F.lit(0 if src.inclusive else 2).alias("_kind"), tied.alias(f"_{name}"))
        points = points.unionByName(known, allowMissingColumns=True)
        aggs.append(F.max_by(f"_{name}.row", f"_{name}.tie").alias(f"_{name}"))
        hits[name] = ("last", f"_{name}")
    if sums is not None:
        rows, column, n = sums
        steps = F.array(F.struct(at.alias("_at"), F.lit(1).alias("_sign")), F.struct(F.date_add(at, n).alias("_at"), F.lit(-1).alias("_sign")))
        moves = rows.filter(F.col(column).isNotNull()).select(*by, F.col(column).alias("_x"), F.inline(steps))
        points = points.unionByName(moves.withColumns({"_kind": F.lit(2), "_x": F.col("_x") * F.col("_sign")}), allowMissingColumns=True)
        aggs += [F.sum("_x").alias("_x"), F.sum("_sign").alias("_n")]
        hits |= {f"{column}_sum": ("sum", "_x"), "_c": ("sum", "_n")}
    points = points.groupBy(*by, "_at", "_kind").agg(*aggs).withColumn("_cell", F.to_date("_at"))
    found = ordered.expanding(points, by, ["_at", "_kind"], hits, cell="_cell").filter("_kind = 1").select(*by, "_at", *hits)
    out = left.join(found.withColumnRenamed("_at", left_on), [*by, left_on], "left")
    if sums is None:
        return out
    return out.withColumn(f"{sums[1]}_sum", F.when(F.col("_c") > 0, F.col(f"{sums[1]}_sum"))).drop("_c")


def entity_fallback_join(fact: DataFrame, tiers: Sequence[tuple[str, DataFrame, Sequence[str]]],
                         cols: Sequence[str]) -> DataFrame:
    """First tier with a match wins: (label, dimension, keys) in order of preference.

    Every dimension must be unique on its keys. Adds the columns and ``match_tier``.
    """
    for i, (_, dim, keys) in enumerate(tiers):
        fact = fact.join(dim.select(*keys, F.struct(*cols).alias(f"_t{i}")), list(keys), "left")
    best = F.coalesce(*[F.col(f"_t{i}") for i in range(len(tiers))])
    label = functools.reduce(lambda e, i: e.when(F.col(f"_t{i}").isNotNull(), tiers[i][0]), range(len(tiers)), F)
    return (fact.withColumn("match_tier", label.otherwise("none"))
            .withColumns({c: best[c] for c in cols}).drop(*[f"_t{i}" for i in range(len(tiers))]))


def war_fallback_join(people: DataFrame, values: DataFrame, group: Sequence[str], season: str,
                      player: str, value: str, name: str) -> DataFrame:
    """Sum over a roster of each player's value one season back, else two back, else 0.

    ``people`` has one row per player of a roster. Both years' values are put next to each
    other first, so that the rows of people are sorted and joined once.
    """
    one_back, two_back = (values.select(player, (F.col(season) + back).alias(season), F.col(value).alias(f"_v{back}")) for back in (1, 2))
    people = people.join(one_back.join(two_back, [player, season], "full"), [player, season], "left")
    one = F.coalesce("_v1", "_v2", F.lit(0).cast(values.schema[value].dataType))
    return people.groupBy(*group).agg(F.sum(one).alias(name))


def anti_seen(df: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(seen.select(*keys), list(keys), "left_anti")


def semi_membership(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members.select(*keys), list(keys), "left_semi")


def window_range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], day: str, days: int,
                      sums: Mapping[str, str]) -> DataFrame:
    """Per left row, sums over right rows dated in [day - days, day) of the same key.

    Right rows are summed per (key, day) beside the days that are asked for, and a frame
    over those days adds them up, so the number of rows does not depend on ``days``.
    """
    asked = left.select(*keys, day).distinct().select(*keys, day, *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in dict.fromkeys(sums.values())])
    both = right.select(*keys, day, *dict.fromkeys(sums.values())).union(asked)
    found = ordered.calendar_range(both, keys, day, {n: ("sum", c) for n, c in sums.items()}, days)
    return left.join(found, [*keys, day], "left")


def grid_aggregate(df: DataFrame, by: Sequence[str], axes: Mapping[str, Sequence[float]],
                   aggs: Callable[[Mapping[str, Column]], Mapping[str, Column]]) -> DataFrame:
    """Aggregates of ``df`` per group at every point of a small parameter grid, from one pass over the rows.

    ``aggs`` gives the named aggregates at a point. All points are columns of one wide
    aggregate, unpivoted afterwards, so rows are never multiplied by the grid.
    """
    points = [{k: F.lit(v) for k, v in zip(axes, p)} for p in itertools.product(*axes.values())]
    wide, cells = [], []
    for i, point in enumerate(points):
        found = aggs(point)
        wide += [agg.alias(f"_{i}_{name}") for name, agg in found.items()]
        cells.append(F.struct(*[v.alias(k) for k, v in point.items()], *[F.col(f"_{i}_{name}").alias(name) for name in found]))
    return df.groupBy(*by).agg(*wide).select(*by, F.inline(F.array(*cells)))


def id_crosswalk_join(fact: DataFrame, crosswalk: DataFrame, attributes: DataFrame, source_id: str, register_id: str,
                      order: Sequence[str]) -> DataFrame:
    """source id -> register id -> attributes; both tables reduced to one row per id first."""
    walk = ordered.first(crosswalk, [source_id], order, [register_id])
    attrs = ordered.first(attributes, [register_id], [c for c in attributes.columns if c != register_id])
    return fact.join(walk, source_id, "left").join(attrs, register_id, "left")


def result_match_join(bets: DataFrame, finals: DataFrame, day: str = "game_date") -> DataFrame:
    """Match pending bets with finals by day, the text 'AWAY @ HOME' and, where both have it, the game number."""
    parts = F.split("matchup", " @ ")
    keyed = bets.withColumns({"away": F.trim(F.try_element_at(parts, F.lit(1))), "home": F.trim(F.try_element_at(parts, F.lit(2)))})
    number = ["game_number"] if "game_number" in bets.columns and "game_number" in finals.columns else []
    return keyed.join(finals, [day, "away", "home", *number], "left")


def pivot_back_join(games: DataFrame, wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    return games.join(wide, list(keys), "inner")


def cardinality_guard(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pass rows through; fail the job at run time if a key occurs twice.

    The count per key is taken with map-side combining and rides along as a left
    join, so no count is collected on the driver.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    text = F.lit("join would multiply rows: key occurs more than once: " + ", ".join(keys))
    # a left join, not a filter, so that the optimizer cannot drop the check
    checked = df.join(per_key, list(keys), "left")
    return checked.filter(F.when(F.col("_n").isNotNull(), F.raise_error(text).cast("boolean")).otherwise(F.lit(True))).drop("_n")
