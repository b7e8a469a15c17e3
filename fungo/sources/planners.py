"""What is missing: watermarks, gaps and completeness of cached data, as frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def watermark_by_year(cached: DataFrame, year: str, first: int, last: int) -> DataFrame:
    """Years after the newest cached one."""
    top = cached.agg(F.coalesce(F.max(year), F.lit(first - 1)).alias("_top"))
    return top.select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year), "_top").filter(F.col(year) > F.col("_top")).drop("_top")


def missing_dates(cached: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Calendar dates without a cached row."""
    spark = cached.sparkSession
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias(day))
    return days.join(cached.select(day).distinct(), day, "left_anti")


def missing_snapshots(cached: DataFrame, day: str, first_year: int, last_year: int, today: str, months: Sequence[int] = range(4, 11)) -> DataFrame:
    """First days of in-season months that are not cached and not in the future."""
    spark = cached.sparkSession
    grid = (spark.range(1).select(F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("y"))
            .select("y", F.explode(F.array(*[F.lit(m) for m in months])).alias("m"))
            .select(F.make_date("y", "m", F.lit(1)).alias(day)))
    have = cached.select(F.to_date(F.trunc(day, "month")).alias(day)).distinct()
    return grid.filter(F.col(day) <= F.lit(today).cast("date")).join(have, day, "left_anti")


def missing_entities(wanted: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    return wanted.select(*keys).distinct().join(cached.select(*keys), list(keys), "left_anti")


def tail_refresh(cached: DataFrame, keys: Sequence[str], day: str, end: str) -> DataFrame:
    """Per key, the days from the day after the newest cached one to ``end``."""
    last = F.lit(end).cast("date")
    return (cached.groupBy(*keys).agg(F.max(day).alias("_top")).select(*keys, F.date_add("_top", 1).alias("start"), last.alias("end"))
            .filter(F.col("start") <= F.col("end")))


def cache_completeness(cached: DataFrame, expected: DataFrame, day: str, n: str = "expected") -> DataFrame:
    """Complete where a day has at least the expected number of rows."""
    have = cached.groupBy(day).agg(F.count(F.lit(1)).alias("cached_rows"))
    out = expected.join(have, day, "left").withColumn("cached_rows", F.coalesce("cached_rows", F.lit(0)))
    return out.withColumn("complete", F.col("cached_rows") >= F.col(n))


def replace_by_fetched_keys(base: DataFrame, fetched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows of a re-fetched key give way to the fetched ones."""
    kept = base.join(fetched.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fetched, allowMissingColumns=True)
