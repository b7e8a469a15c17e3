"""Hard negatives by angular triangle filtering.

Vectors become integers, floor(``scale`` * x). An anchor's positives are its best rows of
the same label by inner product; the negatives of a positive are the best rows of other
labels whose score lies in a window below the positive's score.

Every vector's angles to a few reference directions are stored with its norm. For two
vectors and a reference r the triangle inequality of angles gives

    |angle(a, r) - angle(v, r)| <= angle(a, v) <= angle(a, r) + angle(v, r)

(and at most a full turn less that sum), hence an interval of the cosine over all
references and, times the norms, of the score. Angles are widened by ``WIDE`` and scores
by ``SLACK`` of the norms, more than rounding can move them, so the interval is safe.

* The table is written once in blocks of one label that stand near each other: dealt by
  label, nearest reference and angle, so no label or repeated vector is one task. A block
  also has intervals of its own; one that cannot reach any window is not opened.
* In an opened block, rows whose interval overlaps a window that they could still enter
  get integer scores; the others get none.
* Anchors are asked in passes of about ``ANCHORS``, broadcast to all tasks (a few MB). A
  pass reads the blocks twice, for positives and then for negatives; tasks keep the best
  few of each anchor, which are merged. Every pass writes its result.
* Windows start from a threshold of ``SEED`` sampled rows, which more rows only raise.

Every anchor meets every block by its interval, so the work grows with the question; no
pair is skipped but by its bound.

Edge cases: rows with a null id or label, a null or empty vector, or null or non-finite
components take no part. Shorter vectors count as filled up with 0. Rows equal in id,
label and vector are one; other rows of an anchor's id are neither its positives nor its
negatives. Higher scores come first, ties by smaller id. Positives with a negative score
have no window. Scores are exact; one beyond 64 bits stops the job with OverflowError.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fungo.llm.common import stored

SCALE = 256
ANCHORS, SEED, REFERENCES = 1024, 2048, 12
#: Rows of a block, and of a partition.
BLOCK, PART = 256, 8192
WIDE, SLACK = 1e-6, 1e-9
LEAST = np.iinfo(np.int64).min


def _padded(rows: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(x, "<i8") for x in rows]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _wide(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def _quantized(scale: int, batches):
    for b in batches:
        ids, labels, rows = [], [], []
        for i, y, x in zip(*(c.to_pylist() for c in b.columns)):
            if i is None or y is None or not x or None in x:
                continue
            v = np.array(x, np.float64)
            if np.isfinite(v).all():
                v = np.floor(scale * v)
                if np.abs(v).max() >= 2.0 ** 63:
                    raise OverflowError(f"a component of vector {i} is beyond 64 bits")
                ids.append(i)
                labels.append(y)
                rows.append(v.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(rows, pa.binary())], ["vec_id", "label", "v"])


def norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))


def angles(v: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction; a right angle for a row of zeros, whose scores are 0 anyway."""
    v, directions = _wide(v.astype(np.float64), directions)
    n = norms(v)[:, None]
    return np.arccos(np.clip(np.divide(v, n, out=np.zeros_like(v), where=n > 0) @ directions.T, -1, 1))


def references(sample: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each as far as can be from those before."""
    rows = sample[norms(sample) > 0].astype(np.float64)
    if not len(rows):
        return np.ones((1, 1))
    rows /= norms(rows)[:, None]
    picked = [0]
    near = rows @ rows[0]
    while len(picked) < min(count, len(rows)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, rows @ rows[picked[-1]])
    return rows[picked]


def score_bounds(near: np.ndarray, far: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of scores from bounds of the angle and of the product of norms."""
    low, high = np.cos(np.minimum(far + WIDE, np.pi)), np.cos(np.maximum(near - WIDE, 0))
    slack = SLACK * most + 0.5
    return np.where(low > 0, least, most) * low - slack, np.where(high > 0, most, least) * high + slack


def apart(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the angle of anchors (rows, by reference) to vectors with angles from ``low`` to ``high`` (rows, by reference)."""
    a, low, high = a[:, None, :], low[None], high[None]
    near = np.maximum(np.maximum(low - a, a - high), 0).max(axis=2)
    most = np.where(a + high <= np.pi, a + high, np.where(a + low >= np.pi, 2 * np.pi - a - low, np.pi))
    return near, most.min(axis=2)


def exact(a: np.ndarray, v: np.ndarray, most: float) -> np.ndarray:
    """Inner products as 64-bit integers; ``most`` bounds the product of norms."""
    a, v = _wide(a, v)
    if most < 2.0 ** 52:
        return (a.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    out = [[int(x) for x in row] for row in a.astype(object) @ v.astype(object).T]
    return np.array(out, np.int64).reshape(len(a), len(v))


def _angled(directions: np.ndarray, batches):
    for b in batches:
        if b.num_rows:
            v = _padded(b.column(2).to_pylist())
            t = angles(v, directions)
            cell = t.argmin(axis=1)
            more = [pa.array(norms(v)), pa.array([x.tobytes() for x in t], pa.binary()), pa.array(cell, pa.int32()), pa.array(t[np.arange(len(t)), cell])]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "norm", "angles", "cell", "near"])


BLOCKS = "label long, n int, ids binary, norms binary, angles binary, v binary"


def _blocks(batches):
    """Runs of at most ``BLOCK`` rows of one label and reference."""
    for b in batches:
        label, cell = (b.column(c).to_numpy(zero_copy_only=False) for c in ("label", "cell"))
        cuts = np.flatnonzero((label[1:] != label[:-1]) | (cell[1:] != cell[:-1])) + 1
        rows = []
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows]):
            for i in range(lo, hi, BLOCK):
                p = b.slice(i, min(BLOCK, hi - i))
                rows.append((int(label[i]), p.num_rows, p.column("vec_id").to_numpy().tobytes(), p.column("norm").to_numpy().tobytes(),
                             b"".join(p.column("angles").to_pylist()), _padded(p.column("v").to_pylist()).tobytes()))
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], [x.split()[0] for x in BLOCKS.split(", ")])


class Asked:
    """Anchors of a pass, and windows of scores [low, high] of each (none: low above high); negatives are of other labels."""

    def __init__(self, table: pa.Table, directions: np.ndarray, k: int):
        self.ids, self.labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        self.v = _padded(table.column("v").to_pylist())
        self.norms, self.angles = norms(self.v), angles(self.v, directions)
        self.k, self.other = k, False
        self.low = np.full((len(self.ids), 1), LEAST)
        self.high = np.full((len(self.ids), 1), np.iinfo(np.int64).max)

    def search(self, blocks):
        """(anchor, window, id, score) of the best k rows in every window, over ``blocks`` (label, ids, norms, angles, v)."""
        shape = (*self.low.shape, self.k)
        best, who, least = np.full(shape, LEAST), np.zeros(shape, np.int64), self.low.copy()
        for label, ids, size, turn, v in blocks:
            mine = np.flatnonzero((self.labels != label) if self.other else (self.labels == label))
            near, far = apart(self.angles[mine], turn.min(axis=0)[None], turn.max(axis=0)[None])
            a = self.norms[mine, None]
            low, high = score_bounds(near, far, a * size.min(), a * size.max())
            mine = mine[((high >= least[mine]) & (low <= self.high[mine]) & (least[mine] <= self.high[mine])).any(axis=1)]
            if not len(mine):
                continue
            low, high = score_bounds(*apart(self.angles[mine], turn, turn), *[self.norms[mine, None] * size] * 2)
            floor, roof = least[mine][:, None], self.high[mine][:, None]
            meets = ((high[..., None] >= floor) & (low[..., None] <= roof) & (floor <= roof)).any(axis=2) & (ids != self.ids[mine, None])
            on, rows = meets.any(axis=1), meets.any(axis=0)
            if not on.any():
                continue
            mine, meets, cand = mine[on], meets[np.ix_(on, rows)], ids[rows]
            scores = exact(self.v[mine], v[rows], float(self.norms[mine].max() * size.max()))
            for w in range(self.low.shape[1]):
                inside = meets & (scores >= least[mine, w, None]) & (scores <= self.high[mine, w, None])
                some = np.flatnonzero(inside.any(axis=1))
                if not len(some):
                    continue
                at = mine[some]
                s = np.concatenate([best[at, w], np.where(inside[some], scores[some], LEAST)], axis=1)
                i = np.concatenate([who[at, w], np.broadcast_to(cand, (len(at), len(cand)))], axis=1)
                # LEAST is no score of a window, so its ids do not matter
                order = np.lexsort((i, -np.maximum(s, LEAST + 1)), axis=1)[:, :self.k]
                best[at, w], who[at, w] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
                least[at, w] = np.maximum(self.low[at, w], best[at, w, -1])
        at, w, j = np.nonzero(best != LEAST)
        return at, w, who[at, w, j], best[at, w, j]


def _read(batches):
    for b in batches:
        for label, n, ids, size, turn, v in zip(*(c.to_pylist() for c in b.columns)):
            yield label, np.frombuffer(ids, np.int64), np.frombuffer(size), np.frombuffer(turn).reshape(n, -1), np.frombuffer(v, np.int64).reshape(n, -1)


FOUND = "anchor int, w int, vec_id long, score long"


def _search(asked, batches):
    at, w, ids, scores = asked.value.search(_read(batches))
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["anchor", "w", "vec_id", "score"])


def _best(blocks: DataFrame, asked, k: int) -> DataFrame:
    found = blocks.mapInArrow(partial(_search, asked), FOUND)
    order = W.partitionBy("anchor", "w").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _started(asked: Asked, sample: pa.Table) -> None:
    """Raises the windows' lower ends to the k-th best score among the sampled rows in them."""
    v = _padded(sample.column("v").to_pylist())
    if len(v) < asked.k or not len(asked.ids):
        return
    scores = exact(asked.v, v, float(asked.norms.max() * norms(v).max()))
    fits = (sample.column("label").to_numpy() == asked.labels[:, None]) != asked.other
    fits &= sample.column("vec_id").to_numpy() != asked.ids[:, None]
    for w in range(asked.low.shape[1]):
        inside = np.where(fits & (scores <= asked.high[:, w, None]), scores, LEAST)
        asked.low[:, w] = np.maximum(asked.low[:, w], np.partition(inside, -asked.k, axis=1)[:, -asked.k])


def mined(vectors: DataFrame, is_anchor: str, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding).

    ``is_anchor`` is a condition on vec_id. A negative's score lies from ``low`` to
    ``high`` hundredths of the positive's.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = stored(rows.mapInArrow(partial(_quantized, scale), "vec_id long, label long, v binary").distinct(), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id", "label", "v")).limit(SEED).toArrow()
    directions = references(_padded(sample.column("v").to_pylist()), REFERENCES)
    angled = rows.mapInArrow(partial(_angled, directions), "vec_id long, label long, v binary, norm double, angles binary, cell int, near double")
    order = ["label", "cell", "near", "vec_id"]
    blocks = angled.repartitionByRange(rows.count() // PART + 1, *order).sortWithinPartitions(*order)
    blocks = stored(blocks.mapInArrow(_blocks, BLOCKS), "blocks")
    anchors = rows.where(is_anchor)
    passes = anchors.count() // ANCHORS + 1
    anchors, parts = anchors.withColumn("turn", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(passes))), []
    for turn in range(passes):
        asked = Asked(anchors.where(F.col("turn") == turn).drop("turn").toArrow(), directions, positives)
        _started(asked, sample)
        sent = spark.sparkContext.broadcast(asked)
        # at most so many positives for each anchor of the pass
        found = _best(blocks, sent, positives).toArrow()
        sent.destroy()
        at, place, ids, scores = (found.column(c).to_pylist() for c in ("anchor", "rank", "vec_id", "score"))
        asked.low, asked.high = np.full((len(asked.ids), positives), 1), np.full((len(asked.ids), positives), 0)
        for i, p, s in zip(at, place, scores):
            if -(-low * s // 100) <= high * s // 100:
                asked.low[i, p - 1], asked.high[i, p - 1] = -(-low * s // 100), high * s // 100
        asked.k, asked.other = negatives, True
        _started(asked, sample)
        names = spark.createDataFrame([(i, p - 1, int(asked.ids[i]), d, s) for i, p, d, s in zip(at, place, ids, scores)],
                                      "anchor int, w int, anchor_id long, positive_id long, positive_score long")
        sent = spark.sparkContext.broadcast(asked)
        part = _best(blocks, sent, negatives).join(names, ["anchor", "w"])
        parts.append(stored(part.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        sent.destroy()
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
