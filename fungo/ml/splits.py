"""Time-respecting splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from fungo.operators import ordered


def walk_forward_split(df: DataFrame, season: str, test: int) -> tuple[DataFrame, DataFrame]:
    """Everything before a season to train on, the season itself to test on."""
    return df.filter(F.col(season) < test), df.filter(F.col(season) == test)


def test_seasons(df: DataFrame, season: str = "season", least: int = 1) -> list[int]:
    """Seasons of the data that have at least ``least`` seasons before them; a value a season comes to the driver."""
    return sorted(r[0] for r in df.select(season).where(F.col(season).isNotNull()).distinct().collect())[least:]


def time_series_folds(df: DataFrame, order: Sequence[str], k: int, name: str = "fold") -> DataFrame:
    """k expanding folds over rows in time order: the fold a row is tested in, -1 for the first stretch.

    Test stretches have n // (k + 1) rows and end at the last row; fold i trains on
    every row with a smaller fold. Positions come from cells of the first order
    column, so the rows are never put in one partition.
    """
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    placed = ordered.ranked(df, [], order, "_pos").withColumn("_n", n)
    size = F.floor(F.col("_n") / (k + 1))
    first = F.col("_n") - k * size
    fold = F.when(F.col("_pos") <= first, -1).otherwise(F.floor((F.col("_pos") - 1 - first) / size))
    return placed.withColumn(name, fold.cast("int")).drop("_pos", "_n")
