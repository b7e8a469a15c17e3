"""Periodic runs of words inside each text, by an enhanced suffix array.

A run is a stretch of words with smallest period q that no neighbouring word extends.
Runs are found for many documents at a time, without a tree:

* Suffixes are sorted by prefix doubling, first by document, so that a document's suffixes
  stand together; each document ends in a mark of its own, so nothing reaches over its end.
  The ranks of every doubling step are kept: equal ranks of step k say that 2^k words agree.
* Heights of neighbours (LCP) and their intervals come from those ranks and from pointer
  jumping to the next smaller height.
* Branching tandem test: an interval of depth d holds the suffixes that share d words. For
  every suffix i of every child but the largest, i + d and i - d are looked up in the
  inverse suffix array (ISA); inside the interval and outside of the child, they start a
  square of period d that the next word breaks. Every run ends in such a square.
* The square is rotated to the left while the words agree, in powers of two by the kept
  ranks, which gives the run. Multiples of a period find the same stretch, whose smallest
  period is kept.

Leaving out the largest child bounds the lookups by n log n words of a text; they are made
in slices of ``SLICE``. A text is never cut. Memory grows with the longest text (about 4
bytes a word and doubling step), not with the table. No rows are exchanged.

Edge cases: a null text has no words and no runs; an empty one neither. Words are compared
as bytes. Rows with a null id, repeated rows and ties are rows like others. Columns of the
input stay; a result column whose name is taken gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from fungo.llm.common import chunks, free, texts

#: Bytes of text whose suffixes are sorted together.
TOGETHER = 1 << 20
#: Suffixes looked up at a time.
SLICE = 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def suffixes(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Suffix array, LCP with the suffix before, and ranks after each doubling step (the last are the ISA).

    Words are numbered over all documents, one place after each document is its mark.
    """
    docs, total = len(sizes), len(codes)
    n, width = total + docs, int(codes.max(initial=0)) + 2
    own = np.repeat(np.arange(docs, dtype=np.int64), sizes)
    key = np.empty(n, np.int64)
    key[np.cumsum(sizes) + np.arange(docs)] = np.arange(docs, dtype=np.int64) * width
    key[np.arange(total) + own] = own * width + codes + 1
    sa = np.argsort(key).astype(np.int32)
    h, steps = 1, []
    sel, pos, ordered, rank = np.arange(n, dtype=np.int32), sa, key[sa], np.empty(n, np.int32)
    while True:
        fresh = np.empty(len(sel), bool)
        fresh[:1] = True
        np.not_equal(ordered[1:], ordered[:-1], out=fresh[1:])
        rank[pos] = np.maximum.accumulate(np.where(fresh, sel, 0))
        steps.append(rank)
        alone = fresh & np.append(fresh[1:], True)
        sel = sel[~alone]
        if not len(sel):
            break
        pos = sa[sel]
        key = rank[pos].astype(np.int64) * n + rank[pos + h]
        order = np.argsort(key)
        pos, ordered = pos[order], key[order]
        sa[sel], rank, h = pos, rank.copy(), 2 * h
    lcp = np.zeros(n + 1, np.int32)
    at = 1 + np.flatnonzero(steps[0][sa[1:]] == steps[0][sa[:-1]])
    a, b = sa[at - 1], sa[at]
    for k in range(len(steps) - 1, -1, -1):
        same = steps[k][a] == steps[k][b]
        a, b = a + (same << k), b + (same << k)
    lcp[at] = a - sa[at - 1]
    return sa, lcp, steps


def _smaller(lcp: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """Next place with a smaller height than ``at`` has, to the left or right."""
    near = np.arange(len(lcp)) + step
    left = at
    while len(left):
        left = left[lcp[near[left]] >= lcp[left]]
        near[left] = near[near[left]]
    return near[at]


def squares(sa: np.ndarray, lcp: np.ndarray, isa: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(start, period) of every branching square, perhaps more than once."""
    n = len(sa)
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return
    first, end, depth = _smaller(lcp, at, -1), _smaller(lcp, at, 1), lcp[at]
    order = np.lexsort((at, depth, first))
    at, first, end, depth = at[order], first[order], end[order], depth[order]
    # children of an interval start at its first suffix and at each place of its height
    opens = np.append(True, (first[1:] != first[:-1]) | (depth[1:] != depth[:-1]))
    interval = np.cumsum(opens) - 1
    lo = np.insert(at, np.flatnonzero(opens), first[opens])
    of = np.insert(interval, np.flatnonzero(opens), interval[opens])
    last = np.append(of[1:] != of[:-1], True)
    hi = np.where(last, end[opens][of], np.append(lo[1:], 0))
    size = hi - lo
    by = np.lexsort((size, of))
    keep = np.ones(len(lo), bool)
    keep[by[np.append(of[by][1:] != of[by][:-1], True)]] = False  # the largest child
    lo, hi, of, size = lo[keep], hi[keep], of[keep], size[keep]
    first, end, depth = first[opens], end[opens], depth[opens]
    upto = np.cumsum(size)
    start = 0
    while start < len(lo):
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + SLICE, "right")))
        m = size[start:stop]
        child = np.repeat(np.arange(start, stop), m)
        i = sa[np.arange(len(child)) - np.repeat(np.cumsum(m) - m, m) + lo[child]].astype(np.int64)
        d = depth[of[child]].astype(np.int64)
        for j, begin in ((i + d, i), (i - d, i - d)):
            on = np.flatnonzero((j >= 0) & (j < n))
            c = child[on]
            r = isa[j[on]]
            hit = on[(r >= first[of[c]]) & (r < end[of[c]]) & ((r < lo[c]) | (r >= hi[c]))]
            yield begin[hit], d[hit]
        start = stop


def find(codes: np.ndarray, sizes: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of at least so many words and periods, in this order."""
    sizes = np.asarray(sizes, np.int64)
    if not len(codes):
        return np.zeros((0, 4), np.int64)
    sa, lcp, steps = suffixes(np.asarray(codes, np.int64), sizes)
    found = list(squares(sa, lcp, steps[-1]))
    begin, period = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    begin, period = np.unique(np.stack([begin, period], 1), axis=0).T
    end = begin + 2 * period
    for k in range(len(steps) - 1, -1, -1):
        back = begin - (1 << k)
        inside = np.maximum(back, 0)
        same = (back >= 0) & (steps[k][inside] == steps[k][inside + period])
        begin = np.where(same, back, begin)
    length = end - begin
    on = length >= np.maximum(min_length, min_exponent * period)
    begin, length, period = begin[on], length[on], period[on]
    order = np.lexsort((period, length, begin))
    begin, length, period = begin[order], length[order], period[order]
    new = np.append(True, (begin[1:] != begin[:-1]) | (length[1:] != length[:-1]))[:len(begin)]
    begin, length, period = begin[new], length[new], period[new]
    starts = np.cumsum(sizes + 1) - sizes - 1
    doc = np.searchsorted(starts, begin, "right") - 1
    rows = np.stack([doc, begin - starts[doc], length, period], 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


def annotate(items: list[bytes], min_length: int, min_exponent: int) -> tuple[list, list, list]:
    """Word counts, runs and collapsed texts of some texts."""
    words = [x.split() for x in items]
    numbers, sizes = _Numbers(), np.fromiter(map(len, words), np.int64, len(words))
    codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
    rows = find(codes, sizes, min_length, min_exponent)
    runs: list[list] = [[] for _ in items]
    for doc, start, length, period in rows.tolist():
        runs[doc].append({"start": start, "length": length, "period": period})
    collapsed = []
    for ws, own in zip(words, runs):
        if own:
            drop = np.zeros(len(ws) + 1, np.int64)
            for r in own:
                drop[r["start"] + r["period"]] += 1
                drop[r["start"] + r["length"]] -= 1
            ws = compress(ws, (np.cumsum(drop)[:-1] == 0).tolist())
        collapsed.append(b" ".join(ws).decode("utf-8", "replace"))
    return sizes.tolist(), runs, collapsed


def annotated(docs: DataFrame, text: str = "text", min_length: int = 24, min_exponent: int = 3,
              names: tuple[str, str, str] = ("n_words", "runs", "collapsed")) -> DataFrame:
    """``docs`` plus the number of words, the runs by start then period, and the text with runs collapsed.

    Of each run only the first period stays in the collapsed text, whose words stand one
    blank apart.
    """
    if min_length < 1 or min_exponent < 2:
        raise ValueError("a run has at least one word and two periods")
    at, fields, out = docs.columns.index(text), list(docs.schema.fields), docs
    kinds = StructType.fromDDL(f"a bigint, b {RUNS}, c string")
    for name, kind in zip(names, kinds):
        name = free(out, name)
        fields.append(StructField(name, kind.dataType))
        out = out.withColumn(name, out[text])
    labels = out.columns[-3:]
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for b in batches:
            items, got = texts(b.column(at)), ([], [], [])
            for i, j in chunks(items, TOGETHER):
                for column, part in zip(got, annotate(items[i:j], min_length, min_exponent)):
                    column.extend(part)
            made = [pa.array(got[0], pa.int64()), pa.array(got[1], pa.list_(item)), pa.array(got[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], [*b.schema.names, *labels])

    return docs.mapInArrow(run, StructType(fields))
