"""Weighted blends of model probabilities, computed in the row."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def weighted_blend(weights: Mapping[str, float], columns: Sequence[str]) -> Column:
    """sum(w * p) / sum(w) over the models that exist and have a value."""
    parts = [(F.col(m), float(w)) for m, w in weights.items() if m in columns]
    top, total = F.lit(0.0), F.lit(0.0)
    for p, w in parts:
        top = top + F.coalesce(p * w, F.lit(0.0))
        total = total + F.when(p.isNotNull(), F.lit(w)).otherwise(0.0)
    return F.when(total > 0, top / total)


def weight_grid(models: Sequence[str], trio: Sequence[str], steps: Sequence[float] = (0.1, 0.2, 0.3, 0.4), least: float = 0.2) -> dict[str, dict[str, float]]:
    """Candidate weight sets: each model alone, all equal, pairs equal, and a grid over three models."""
    sets = {f"only_{m}": {m: 1.0} for m in models}
    sets["equal_all"] = {m: 1 / len(models) for m in models}
    sets.update({f"pair_{a}_{b}": {a: 0.5, b: 0.5} for a, b in itertools.combinations(models, 2)})
    for x, y in itertools.product(steps, repeat=2):
        z = round(1.0 - x - y, 2)
        if z >= least:
            sets[f"grid_{x:.1f}_{y:.1f}_{z:.1f}"] = dict(zip(trio, (x, y, z)))
    return sets


def blend_grid(wide: DataFrame, sets: Mapping[str, Mapping[str, float]], aggs: Callable[[Column], Mapping[str, Column]]) -> DataFrame:
    """A row per weight set: model and the aggregates that ``aggs`` makes of its blend.

    The aggregates of all sets are columns of one pass, unpivoted afterwards; rows are not
    multiplied by the sets. Without input rows every set has one row still.
    """
    have, columns, cells = wide.columns, [], []
    for i, (name, weights) in enumerate(sets.items()):
        found = aggs(weighted_blend(weights, have))
        columns += [agg.alias(f"_{i}_{k}") for k, agg in found.items()]
        cells.append(F.struct(F.lit(name).alias("model"), *[F.col(f"_{i}_{k}").alias(k) for k in found]))
    return wide.agg(*columns).select(F.inline(F.array(*cells)))
