"""Exact top-k search by inner product with MaxScore.

Components are the terms of a query, a component's column of a shard is its postings
list. Vectors are turned into integers, floor(``SCALE`` * x), and dealt into shards of
about ``SHARD`` rows; queries come in blocks of about ``BLOCK``. For a query and a shard
a term's bound is the most it can add there, from the column's largest and smallest
value.

* A threshold is known from the start: the k-th best score among ``SEED`` vectors, which
  any k vectors of the table can only raise.
* Terms with the smallest bounds that together stay below the threshold are not
  essential. The essential lists are traversed for all rows of the shard; a row stays
  while its sum plus the bounds that are left reaches the threshold, and the other terms
  are probed for such rows only, a few at a time, the largest bounds first.
* Each shard returns its best k per query that reach the threshold; they are merged.

Every query meets every shard, in blocks, so the work is as large as the question; no
pair is skipped but by its bound.

Edge cases: vectors that are null, empty or hold null or non-finite components take no
part, as do rows without an id. Shorter vectors count as filled up with 0. Rows equal in
id and vector are one; of rows that share an id each is a candidate, but not for queries
of that id. Ties go to the smaller id. With fewer than k candidates all are returned.
Sums are exact while they stay below 2^53.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fungo.llm.common import stored

SCALE = 64
SHARD = 8192
BLOCK = 1024
SEED = 2048
PROBE = 8


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of packed integers as doubles, padded with 0."""
    rows = [np.frombuffer(x, "<i8") for x in column.to_pylist()]
    out = np.zeros((len(rows), max(map(len, rows), default=0)))
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _quantized(scale: int, batches):
    for b in batches:
        ids, found, rows = b.column(0).to_pylist(), [], []
        for i, x in zip(ids, b.column(1).to_pylist()):
            if i is None or not x or None in x:
                continue
            v = np.array(x, np.float64)
            if np.isfinite(v).all():
                found.append(i)
                rows.append(np.floor(scale * v).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "v"])


def _padded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def _thresholds(k: int, ids: np.ndarray, seed: np.ndarray, batches):
    """Queries with the k-th best score among the seed vectors of other ids."""
    for b in batches:
        if not b.num_rows:
            continue
        q, s = _padded(_matrix(b.column(1)), seed)
        scores = q @ s.T
        scores[b.column(0).to_numpy()[:, None] == ids[None, :]] = -np.inf
        least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least, pa.float64())], ["query_id", "q", "least"])


def best(q: np.ndarray, own: int, least: float, columns: np.ndarray, ids: np.ndarray, high: np.ndarray, low: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the best k rows that reach ``least``; ``columns`` has a row per term."""
    bound = np.maximum(q * high, q * low)
    order = np.argsort(bound, kind="stable")
    rest = np.cumsum(bound[order])
    cut = int(np.searchsorted(np.maximum.accumulate(rest), least)) if np.isfinite(least) else 0
    cut = min(cut, len(order) - 1)
    rows = np.flatnonzero(ids != own)
    essential = order[cut:]
    score = q[essential] @ columns[essential]
    left = rest[cut - 1] if cut else 0.0
    rows = rows[score[rows] + left >= least]
    score = score[rows]
    while cut:
        step = order[max(0, cut - PROBE):cut]
        cut = max(0, cut - PROBE)
        score = score + q[step] @ columns[np.ix_(step, rows)]
        left = rest[cut - 1] if cut else 0.0
        on = score + left >= least
        rows, score = rows[on], score[on]
    pick = np.lexsort((ids[rows], -score))[:k]
    return rows[pick], score[pick]


def _search(k: int, shard: pa.Table, queries: pa.Table) -> pa.Table:
    names, out = ["query_id", "q_hash", "vec_id", "score"], ([], [], [], [])
    if shard.num_rows and queries.num_rows:
        q, v = _padded(_matrix(queries.column("q")), _matrix(shard.column("v")))
        ids, columns = shard.column("vec_id").to_numpy(), np.ascontiguousarray(v.T)
        high, low = v.max(axis=0), v.min(axis=0)
        for i, own, mark, least in zip(range(len(q)), *(queries.column(c).to_pylist() for c in ("query_id", "q_hash", "least"))):
            rows, score = best(q[i], own, least, columns, ids, high, low, k)
            out[0].extend([own] * len(rows))
            out[1].extend([mark] * len(rows))
            out[2].extend(ids[rows].tolist())
            out[3].extend(score.astype(np.int64).tolist())
    return pa.table([pa.array(c, pa.int64()) for c in out], names)


def search(vectors: DataFrame, is_query: str, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``vectors`` (vec_id, embedding); ``is_query`` is a condition on vec_id."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(partial(_quantized, scale), "vec_id long, v binary").distinct(), "vectors")
    n = rows.count()
    seed = rows.orderBy(F.xxhash64("vec_id", "v")).limit(SEED).toArrow()
    asked = rows.where(is_query)
    blocks, shards = asked.count() // BLOCK + 1, n // SHARD + 1
    asked = asked.mapInArrow(partial(_thresholds, k, seed.column(0).to_numpy(), _matrix(seed.column(1))), "query_id long, q binary, least double")
    asked = asked.withColumn("q_hash", F.xxhash64("q")).withColumn("block", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks)))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("shard", F.col("shard").cast("long"))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumn("block", F.col("block").cast("long"))

    def run(left, right):
        return _search(k, left, right)

    found = dealt.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(run, "query_id long, q_hash long, vec_id long, score long")
    order = W.partitionBy("query_id", "q_hash").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
