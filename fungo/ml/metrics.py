"""Classification metrics as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from fungo.operators import ordered
from fungo.operators.decision import exact_avg


def long_form(df: DataFrame, ids: Sequence[str], models: Mapping[str, str]) -> DataFrame:
    """One row per (row, model) with columns model and p."""
    parts = [F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in models.items()]
    return df.select(*ids, F.inline(F.array(*parts)))


def auc(long: DataFrame, keys: Sequence[str], p: str = "p", y: str = "home_win") -> DataFrame:
    """Exact area under the curve, ties counted half.

    Rows are counted per distinct score first; ranks are running sums over cells of
    the score range, so no task sees a whole group in order.
    """
    per = long.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(F.count_if(F.col(y) == 1).alias("_pos"), F.count_if(F.col(y) == 0).alias("_neg"))
    cells = per.withColumn("_cell", F.floor(F.col("_p") * 1024))
    below = ordered.expanding(cells, keys, ["_p"], {"_below": ("sum", "_neg")}, cell="_cell")
    won = F.col("_pos").cast("decimal(20,0)") * (2 * F.coalesce("_below", F.lit(0)) + F.col("_neg"))
    out = below.groupBy(*keys).agg(F.sum(won).cast("double").alias("_w"), F.sum("_pos").alias("_np"), F.sum("_neg").alias("_nn"))
    value = F.try_divide(F.col("_w"), 2.0 * F.col("_np") * F.col("_nn"))
    return out.select(*keys, value.alias("auc"))


def by_year(long: DataFrame, keys: Sequence[str] = ("model", "season"), p: str = "p", y: str = "home_win", eps: float = 1e-15) -> DataFrame:
    """Games, accuracy, log loss, Brier, AUC and mean confidence per key."""
    prob, hit = F.col(p), F.col(y)
    safe = F.greatest(F.least(prob, F.lit(1 - eps)), F.lit(eps))
    loss = -F.when(hit == 1, F.log(safe)).otherwise(F.log(1 - safe))
    gap = prob - hit
    base = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("games"), F.avg(((prob >= 0.5) == (hit == 1)).cast("int")).alias("accuracy"),
        exact_avg(loss).alias("log_loss"), exact_avg(gap * gap).alias("brier"), exact_avg(F.greatest(prob, 1 - prob)).alias("avg_confidence"))
    return base.join(auc(long, keys, p, y), list(keys), "left")
