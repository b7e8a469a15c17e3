"""Training and scoring on spark.ml, always on earlier seasons or folds."""

from __future__ import annotations

import functools
import itertools
import random
import uuid
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from fungo.functions.labels import recency_weight
from fungo.ml import metrics
from fungo.ml.splits import time_series_folds, walk_forward_split
from fungo.operators import aggregates as a
from fungo.operators.decision import exact_sum
from fungo.session import checkpoint_root

T = TypeVar("T")

# Limits of calibrated edges and probabilities.
EDGE_LIMIT, PROB_LIMITS = 0.20, (0.01, 0.99)


def prob(column: str = "probability") -> Column:
    return vector_to_array(column)[1]


# --- preparation ----------------------------------------------------------

def median_impute(df: DataFrame, cols: Sequence[str], train: DataFrame | None = None) -> DataFrame:
    """Fill nulls with exact medians of the training rows, all found by one subquery."""
    mid = a.median(df if train is None else train, [], cols).select(F.struct(*cols).alias("m")).scalar()
    return df.withColumns({c: F.coalesce(F.col(c), mid[c]) for c in cols})


def standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Zero mean and unit (population) variance; a constant column becomes 0.

    Two passes whatever the number of columns: all means, then all spreads around them.
    """
    one = lambda rows, value: rows.agg(F.struct(*[value(c).alias(c) for c in cols]).alias("x")).scalar()
    mean = one(df, lambda c: exact_sum(F.col(c)) / F.count(c))
    gaps = df.withColumns({c: F.col(c) - mean[c] for c in cols})
    spread = one(gaps, lambda c: F.sqrt(exact_sum(F.col(c) * F.col(c)) / F.count(c)))
    return gaps.withColumns({c: F.coalesce(F.try_divide(F.col(c), spread[c]), F.lit(0.0)) for c in cols})


# --- several fits at once ---------------------------------------------------

def together(tasks: Sequence[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Results of independent tasks, ``at_once`` of them as concurrent jobs of the fair pool 'fits'.

    Fits of small data leave most of a cluster idle while they wait for each other's
    steps; jobs of several fits fill it.
    """
    def run(task: Callable[[], T]) -> T:
        SparkContext.getOrCreate().setLocalProperty("spark.scheduler.pool", "fits")
        return task()

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(run, tasks))


def held(df: DataFrame) -> DataFrame:
    """``df`` written once to the session's shared folder, for fits that read it many times.

    Concurrent jobs then share files, not a plan: a kept frame's plan, with its subqueries and
    the stages that are still running, would be sent along with every job that reads it.
    """
    path = f"{checkpoint_root(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- estimators -----------------------------------------------------------

def logistic(features: Sequence[str], label: str = "home_win", weight: str | None = None, c: float = 1.0) -> Pipeline:
    """Standardised logistic regression with an L2 penalty of 1 / c."""
    extra = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="error"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(labelCol=label, featuresCol="features", maxIter=100, regParam=1e-4 / c, **extra)])


def boosted_trees(features: Sequence[str], label: str = "home_win", weight: str | None = None, trees: int = 40, depth: int = 3,
                  rate: float = 0.1, sample: float = 0.8, seed: int = 42) -> Pipeline:
    """Gradient-boosted trees; compare with other libraries by metrics, not by values."""
    extra = {"weightCol": weight} if weight else {}
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error"),
        GBTClassifier(labelCol=label, featuresCol="features", maxIter=trees, maxDepth=depth, stepSize=rate, subsamplingRate=sample, seed=seed, **extra)])


def score(model: PipelineModel, df: DataFrame, name: str = "p") -> DataFrame:
    out = model.transform(df)
    return out.withColumn(name, prob()).select(*df.columns, name)


def _isotonic(df: DataFrame, x: str, y: str, weight: str | None = None):
    extra = {"weightCol": weight} if weight else {}
    return IsotonicRegression(featuresCol=x, labelCol=y, predictionCol="_iso", isotonic=True, **extra).fit(df)


def calibrated(pipeline: Pipeline, train: DataFrame, test: DataFrame, order: Sequence[str], folds: int = 3, label: str = "home_win",
               weight: str | None = None, name: str = "p") -> DataFrame:
    """Mean over time folds of a model fitted before the fold and an isotonic curve fitted on the fold."""
    marked = held(time_series_folds(train, order, folds))

    def fold(k: int):
        model = pipeline.fit(marked.filter(F.col("fold") < k))
        rest = score(model, marked.filter(F.col("fold") == k), "_x").withColumn("_y", F.col(label).cast("double"))
        return model, _isotonic(rest, "_x", "_y", weight)

    out, parts = test, []
    for k, (model, curve) in enumerate(together([functools.partial(fold, k) for k in range(folds)])):
        out = curve.transform(score(model, out, "_x")).withColumnRenamed("_iso", f"_p{k}").drop("_x")
        parts.append(f"_p{k}")
    mean = functools.reduce(lambda x, y: x + y, [F.col(p) for p in parts]) / folds
    return out.withColumn(name, F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))).drop(*parts)


def random_search(train: DataFrame, features: Sequence[str], order: Sequence[str], space: Mapping[str, Sequence], draws: int = 15, folds: int = 3,
                  seed: int = 42, label: str = "home_win") -> DataFrame:
    """Random draws of boosted-tree settings, scored by mean log loss over time folds; best first."""
    rng = random.Random(seed)
    grid = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    picks = rng.sample(grid, min(draws, len(grid)))
    marked = held(time_series_folds(train, order, folds))

    def fold(i: int, setting: dict, k: int) -> DataFrame:
        model = boosted_trees(features, label, **setting).fit(marked.filter(F.col("fold") < k))
        rest = score(model, marked.filter(F.col("fold") == k))
        return rest.select(F.lit(i).alias("draw"), F.lit(str(setting)).alias("setting"), F.lit(k).alias("model"), F.lit(k).alias("season"), label, "p")

    scored = together([functools.partial(fold, i, setting, k) for i, setting in enumerate(picks) for k in range(folds)])
    by_fold = metrics.by_year(functools.reduce(DataFrame.unionByName, scored), ("draw", "setting", "model"), y=label)
    return by_fold.groupBy("draw", "setting").agg(F.count(F.lit(1)).alias("folds"), F.avg("log_loss").alias("mean_log_loss")).orderBy("mean_log_loss", "draw")


def edge_isotonic(bets: DataFrame, train: DataFrame | None = None) -> DataFrame:
    """Calibrated probability and edge: isotonic curve from edge to (won - market), clipped."""
    base = (bets if train is None else train).dropna(subset=["edge", "market_prob", "won"])
    curve = _isotonic(base.withColumn("_y", F.col("won").cast("int") - F.col("market_prob")), "edge", "_y")
    gain = F.least(F.greatest(F.col("_iso"), F.lit(-EDGE_LIMIT)), F.lit(EDGE_LIMIT))
    lo, hi = PROB_LIMITS
    out = curve.transform(bets).withColumn("calibrated_prob", F.least(F.greatest(F.col("market_prob") + gain, F.lit(lo)), F.lit(hi)))
    return out.withColumn("calibrated_edge", F.col("calibrated_prob") - F.col("market_prob")).drop("_iso")


# --- experiments ----------------------------------------------------------

def walk_forward(df: DataFrame, years: Sequence[int], pipeline: Pipeline, season: str = "season", name: str = "p", weighted: bool = True) -> DataFrame:
    """Out-of-sample probabilities: each year scored by a model of the years before it.

    The table is read once, however many years there are; years are fitted concurrently.
    """
    w = held(df.withColumn("_w", recency_weight(F.col(season)) if weighted else F.lit(1.0)))

    def year(y: int) -> DataFrame:
        train, test = walk_forward_split(w, season, y)
        return score(pipeline.fit(train), test, name).drop("_w")

    return functools.reduce(DataFrame.unionByName, together([functools.partial(year, y) for y in years]))


def stacking(wide: DataFrame, models: Sequence[str], years: Sequence[int], fallback: str, season: str = "season", label: str = "home_win") -> DataFrame:
    """Per year, a logistic regression on base probabilities of earlier years, the last two of them weighted 1.35.

    The first year has nothing before it and takes ``fallback``.
    """
    wide = held(wide)

    def year(y: int) -> DataFrame:
        train, test = walk_forward_split(wide, season, y)
        if y == min(years):
            return test.withColumn("p", F.col(fallback))
        train = train.filter(F.col(season) >= min(years)).withColumn("_w", F.when(F.col(season) >= y - 2, 1.35).otherwise(1.0))
        return score(logistic(models, label, "_w", c=0.5).fit(train), test)

    return functools.reduce(DataFrame.unionByName, together([functools.partial(year, y) for y in years]))


def feature_importance(model: PipelineModel, features: Sequence[str], df: DataFrame) -> DataFrame:
    """Ranked importances of a tree model; one row per feature."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(features, values), key=lambda r: (-r[1], r[0]))
    return df.sparkSession.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(rows)], "place int, feature string, importance double")


def ablation(df: DataFrame, configs: Mapping[str, Sequence[str]], features: Sequence[str], groups: Sequence[str], years: Sequence[int],
             confirm: int = 8, season: str = "season", label: str = "home_win", key: str = "game_pk") -> DataFrame:
    """Configurations that keep some columns of ``groups`` and zero the others, screened by one model, the best confirmed by a blend.

    The screen uses logistic regression, the confirmation the mean of it and boosted trees;
    the probabilities of the screen are kept, so that no regression is fitted twice.
    """
    df = held(df)

    def kept(keep: Sequence[str]) -> DataFrame:
        return df.withColumns({c: F.lit(0.0) for c in groups if c not in keep}) if set(groups) - set(keep) else df

    def screened(name: str, keep: Sequence[str]) -> DataFrame:
        out = walk_forward(kept(keep), years, logistic(features, label, "_w"), season)
        return held(out.select(F.lit("screen").alias("stage"), F.lit(name).alias("config"), key, season, label, "p"))

    def confirmed(name: str) -> DataFrame:
        other = walk_forward(kept(configs[name]), years, boosted_trees(features, label, "_w", trees=10), season, "_t").select(key, "_t")
        both = scored[name].join(other, key).withColumn("p", (F.col("p") + F.col("_t")) / 2)
        return both.withColumn("stage", F.lit("confirm")).drop("_t")

    per = lambda frames: metrics.by_year(functools.reduce(DataFrame.unionByName, frames), ("stage", "config", season), y=label)
    summary = lambda by_year: a.year_macro_average(by_year, ["stage", "config"], ["accuracy", "log_loss", "brier", "auc"])
    scored = dict(zip(configs, together([functools.partial(screened, n, k) for n, k in configs.items()])))
    # read for the ranking and for the result
    screen = held(summary(per(list(scored.values()))))
    best = [r["config"] for r in screen.orderBy("avg_log_loss", "config").select("config").limit(confirm).collect()]
    return screen.unionByName(summary(per(together([functools.partial(confirmed, n) for n in best]))))


def market_comparison(df: DataFrame, features: Sequence[str], market: str, test: int, season: str = "season", label: str = "home_win") -> DataFrame:
    """The same split with and without the market feature, and the market alone, on games with odds and on all.

    The table is read once; both fits and both scores read what is kept of it.
    """
    df = held(df.select(season, label, market, *features))
    train, out = walk_forward_split(df, season, test)
    fill = lambda d: d.withColumn("_m", F.coalesce(market, F.lit(0.5)))
    blind = logistic(features, label).fit(train)
    aware = logistic([*features, "_m"], label).fit(fill(train))
    scored = score(aware, fill(score(blind, out, "blind")), "aware")
    models = {"blind": "blind", "aware": "aware"}
    whole = metrics.long_form(scored, [label], models).withColumn("subset", F.lit("all"))
    priced = metrics.long_form(scored.filter(F.col(market).isNotNull()), [label], {**models, "market": market}).withColumn("subset", F.lit("with odds"))
    return metrics.by_year(whole.unionByName(priced), ("model", "subset"), y=label)


def batch_scoring(model: PipelineModel, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Probabilities for a table of assembled matchups."""
    return score(model, rows).select(*keys, F.col("p").alias("model_home_prob"))


# --- artifacts ------------------------------------------------------------

def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def feature_list(model: PipelineModel) -> list[str]:
    """The columns a saved model was trained on."""
    return list(model.stages[0].getInputCols())


def artifact_manifest(df: DataFrame, model_id: str, features: Sequence[str], day: str = "game_date", season: str = "season") -> DataFrame:
    return df.agg(F.lit(model_id).alias("model_id"), F.count(F.lit(1)).alias("rows"), F.min(season).alias("first_season"), F.max(season).alias("last_season"),
                  F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.lit(len(features)).alias("features"))
