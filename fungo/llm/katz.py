"""Katz backoff language model of order two, and the score of every text.

The probability of a word after another is its discounted count if the pair was seen in
training, else the backoff weight of the first word times the probability of the second
alone, which in turn is discounted against one class of unknown words:

    P(w | h) = d(c(h, w)) c(h, w) / c(h)          if c(h, w) > 0
             = a(h) P(w)                          else, with a(h) = 1 if h is unknown
    P(w)     = d(c(w)) c(w) / N                   if c(w) > 0, else what is left

Counts up to ``K`` are discounted by Good-Turing from the counts of counts of their order
(where these give no discount between 0 and 1, half a count is taken off). Larger counts
give up ``SLIP`` of a count, so every history leaves something for unseen words. a(h) is
what h leaves, divided by the probability of all words not seen after h: both sums run
over all pairs of h, so the probabilities after any history add up to one. Before the
first word stands a history of its own; after the last comes an end token.

How it runs. Word counts are one aggregation, written as a table. The ``HEAVY`` most
frequent words are broadcast (a list of fixed size) with their counts; others are looked
up by joins. Pairs are counted and scored in one exchange: every task packs the pairs of
its documents into one block per part of the pair table, and whoever owns the part counts
each pair over the training documents and gives every document its share of the score. A
part holds all pairs of a history, so c(h) is at hand; pairs of the ``SPLIT`` most frequent
histories are dealt by both words. Discounts are only known once all parts are counted, so
documents carry how many of their pairs were seen once, twice, ... ``K`` times.

Texts are lower-cased (A-Z) and cut at ``[\\x20\\x09-\\x0D]``; words are 64-bit hashes.

Edge cases: a null or empty text is the end token alone. Rows that repeat id and text
count in training as often as they occur and get the same score. Without training rows
every word is unknown and the model gives probability 1 to the class of unknown words.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from fungo.llm.common import WordHashes, stored, texts

K = 5
SLIP = 0.05
HEAVY = 1 << 18
SPLIT = 1 << 14
HELD = 600_000
PART = 3_000_000
RARE = np.uint64(1 << 63)
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def discounts(n: list[int]) -> list[float]:
    """Good-Turing discounts of the counts 1 to K; ``n[r]`` is how many have count r, up to K + 1."""
    plain = [(r - 0.5) / r for r in range(1, K + 1)]
    if min(n[1:K + 2]) == 0:
        return plain
    a = (K + 1) * n[K + 1] / n[1]
    found = [((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a) for r in range(1, K + 1)] if a < 1 else plain
    return found if all(0 < d < 1 for d in found) else plain


def kept(c: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts after discounting."""
    table = np.array([0.0, *(r * x for r, x in enumerate(d, 1))])
    return np.where(c > K, c - SLIP, table[np.minimum(c, K)])


def _documents(batches, limit: int = HELD):
    """Lists of documents (key, training, word hashes with the end token) of about ``limit`` tokens."""
    known, held, size = WordHashes(), [], 0
    for b in batches:
        for key, train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
            w = np.append(known(text.lower().split()), END)
            held.append((key, train, w))
            size += len(w)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _word_counts(batches):
    for docs in _documents(batches, 2_000_000):
        w = [x for _, train, x in docs if train]
        if w:
            w, n = np.unique(np.concatenate(w), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(n)], ["w", "c"])


class Heavy:
    """The most frequent words: sorted hashes, their counts, and how many are split."""

    def __init__(self, w: np.ndarray, c: np.ndarray):
        order = np.argsort(w)
        self.w, self.c = w[order], c[order]
        self.split = np.zeros(len(w) + 1, bool)
        self.split[1:][np.lexsort((self.w, -self.c))[:SPLIT]] = True
        self.split[0] = True  # the history before the first word

    def codes(self, w: np.ndarray) -> np.ndarray:
        """Place + 1 of a heavy word, else its hash with the top bit set."""
        if not len(self.w):
            return w | RARE
        at = np.minimum(np.searchsorted(self.w, w), len(self.w) - 1)
        return np.where(self.w[at] == w, (at + 1).astype(np.uint64), w | RARE)


TOKENS = "key long, w long, n long, nh long, base double, hist double, known long, tokens long"


def _tokens(heavy: Heavy, batches):
    """A row per document with what heavy words add, and a row per document and other word."""
    log_c, log_c1 = np.log10(np.r_[1.0, heavy.c]), np.log10(np.r_[1, heavy.c] + 1.0)
    for docs in _documents(batches):
        sizes = np.array([len(w) for _, _, w in docs])
        keys, doc = np.array([k for k, _, _ in docs], np.int64), np.repeat(np.arange(len(docs)), sizes)
        w = np.concatenate([w for _, _, w in docs])
        code = heavy.codes(w)
        rare, history = code >= RARE, w != END
        at = np.where(rare, 0, code).astype(np.int64)
        n = len(docs)
        base = np.bincount(doc, np.where(rare, 0, log_c1[at]), n)
        hist = np.bincount(doc, np.where(rare | ~history, 0, log_c[at]), n)
        known = np.bincount(doc, ~rare, n).astype(np.int64)
        none = pa.nulls(n).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys), none, none, none, pa.array(base), pa.array(hist), pa.array(known), pa.array(sizes)], [x.split()[0] for x in TOKENS.split(", ")])
        d, c = doc[rare], code[rare]
        if len(d):
            order = np.lexsort((c, d))
            d, c = d[order], c[order]
            first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (c[1:] != c[:-1])])
            n = np.diff(np.r_[first, len(d)])
            nh = np.where(c[first] == (END | RARE), 0, n)
            no, none = pa.nulls(len(first)).cast(pa.float64()), pa.nulls(len(first)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys[d[first]]), pa.array(c[first].astype(np.int64)), pa.array(n), pa.array(nh), no, no, none, none], [x.split()[0] for x in TOKENS.split(", ")])


def _squeezed(a: np.ndarray) -> bytes:
    """An array byte plane by byte plane, compressed; zero planes of small numbers vanish."""
    return zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes(), 1)


def _unsqueezed(b: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


BLOCK = "part int, keys binary, train binary, h binary, w binary, doc binary, n binary"


def _pairs(heavy: Heavy, parts: int, batches):
    """One block per part of the pairs of a task's documents."""
    for docs in _documents(batches):
        keys = np.array([k for k, _, _ in docs], np.int64)
        train = np.array([t for _, t, _ in docs], np.uint8)
        doc = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(w) for _, _, w in docs])
        w = heavy.codes(np.concatenate([w for _, _, w in docs]))
        h = np.r_[np.uint64(0), w[:-1]]
        h[np.r_[True, doc[1:] != doc[:-1]]] = 0
        split = heavy.split[np.where(h >= RARE, 0, h).astype(np.int64)] & (h < RARE)
        mixed = np.where(split, h * _M1 ^ (w + np.uint64(1)) * _M2, (h + np.uint64(3)) * _M1)
        part = ((mixed ^ (mixed >> np.uint64(31))) * _M2 >> np.uint64(33)) % np.uint64(parts)
        order = np.lexsort((doc, w, h, part))
        part, h, w, doc = part[order], h[order], w[order], doc[order]
        first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])])
        n = np.diff(np.r_[first, len(h)]).astype(np.uint32)
        part, h, w, doc = part[first], h[first], w[first], doc[first]
        bounds = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for a, z in zip(bounds[:-1], bounds[1:]):
            there, at = np.unique(doc[a:z], return_inverse=True)
            cells = [_squeezed(x) for x in (keys[there], train[there], h[a:z], w[a:z], at.astype(np.uint32), n[a:z])]
            yield pa.RecordBatch.from_arrays([pa.array([int(part[a])], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], [x.split()[0] for x in BLOCK.split(", ")])


# kind 1: a document's seen pairs; 2: its unseen pairs after h; 3: sums of h; 4: a rare word seen after h; 5: unseen pairs that end in a rare word; 6: counts of counts
FOUND = "kind int, key long, h long, w long, n long, x double, " + ", ".join(f"k{r} long" for r in range(1, K + 2))
NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _rows(kind: int, size: int, **columns):
    out = []
    for name in NAMES:
        if name == "kind":
            out.append(pa.array(np.full(size, kind, np.int32)))
        elif name in columns:
            out.append(pa.array(columns[name]))
        else:
            out.append(pa.nulls(size).cast(pa.float64() if name == "x" else pa.int64()))
    return pa.RecordBatch.from_arrays(out, NAMES)


def _counted(heavy: Heavy, p1: np.ndarray, n_train: int, blocks: list[dict]):
    """Everything that one part of the pair table has to say; ``p1`` are the heavy words' own probabilities."""
    keys, train, h, w, doc, n, base = [], [], [], [], [], [], 0
    while blocks:
        b = blocks.pop()
        keys.append(_unsqueezed(b["keys"], "<i8"))
        train.append(_unsqueezed(b["train"], "u1"))
        h.append(_unsqueezed(b["h"], "<u8"))
        w.append(_unsqueezed(b["w"], "<u8"))
        doc.append(_unsqueezed(b["doc"], "<u4").astype(np.int32) + np.int32(base))
        n.append(_unsqueezed(b["n"], "<u4").astype(np.int32))
        base += len(keys[-1])
    size = base
    keys, train = np.concatenate(keys), np.concatenate(train)
    h, w = np.concatenate(h), np.concatenate(w)
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (w[1:] != w[:-1])])
    pair = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.r_[first, len(h)]))  # the pair of each posting
    h, w = h[first], w[first]
    doc, n = np.concatenate(doc)[order], np.concatenate(n)[order]
    del order
    r = np.add.reduceat(n * train[doc], first, dtype=np.int64)  # training count of each pair
    yield _rows(6, 1, **{f"k{k}": np.array([(r == k).sum()], np.int64) for k in range(1, K + 2)})

    begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    hist = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(h)]))
    hh = h[begin]
    at = np.where(hh >= RARE, 0, hh).astype(np.int64)
    ch = np.where(hh >= RARE, np.add.reduceat(r, begin), np.r_[n_train, heavy.c][at])
    split = heavy.split[at] & (hh < RARE)

    seen, rare_w = r > 0, w >= RARE
    own_p = np.r_[1.0, p1][np.where(rare_w, 0, w).astype(np.int64)]
    unseen = np.log10(own_p) + np.log10(np.maximum(ch, 1))[hist]  # a rare word's own probability comes with kind 5
    x = np.where(seen, np.log10(np.where(r > K, r - SLIP, np.maximum(r, 1))), unseen)
    ks = {f"k{k}": np.bincount(doc, n * (r == k)[pair], size).astype(np.int64) for k in range(1, K + 1)}
    # a document may stand in several blocks, once in each
    yield _rows(1, size, key=keys, x=np.bincount(doc, n * x[pair], size), **ks)

    open_ = ~seen & (ch[hist] > 0)
    for some, kind, column, values in ((open_, 2, "h", h), (~seen & rare_w, 5, "w", w)):
        on = some[pair]
        d, v, k = doc[on], values[pair[on]], n[on].astype(np.int64)
        if len(d):
            o = np.lexsort((v, d))
            d, v, k = d[o], v[o], k[o]
            f = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (v[1:] != v[:-1])])
            yield _rows(kind, len(f), key=keys[d[f]], n=np.add.reduceat(k, f), **{column: v[f].astype(np.int64)})

    need = split.copy()
    need[hist[open_]] = True
    own = np.flatnonzero(need)
    if len(own):
        big = np.bincount(hist, r > K, len(begin)).astype(np.int64)
        sp = np.bincount(hist, np.where(seen & ~rare_w, own_p, 0.0), len(begin))
        ts = {f"k{k}": np.bincount(hist, r == k, len(begin)).astype(np.int64)[own] for k in range(1, K + 1)}
        yield _rows(3, len(own), h=hh[own].astype(np.int64), n=ch[own].astype(np.int64), x=sp[own], **ts, **{f"k{K + 1}": big[own]})
        ends = np.flatnonzero(seen & rare_w & need[hist])
        if len(ends):
            yield _rows(4, len(ends), h=h[ends].astype(np.int64), w=w[ends].astype(np.int64))


def _parts(heavy: Heavy, p1: np.ndarray, n_train: int, batches):
    own: dict[int, list[dict]] = {}
    for b in batches:
        for row in b.to_pylist():
            own.setdefault(row["part"], []).append(row)
    for part in sorted(own):
        yield from _counted(heavy, p1, n_train, own.pop(part))


def _kept_sql(c: str, d: list[float]) -> str:
    return f"CASE WHEN {c} > {K} THEN {c} - {SLIP}D " + " ".join(f"WHEN {c} = {r} THEN {r * x!r}D" for r, x in enumerate(d, 1)) + " ELSE 0D END"


def scores(docs: DataFrame, training: str) -> DataFrame:
    """(key, doc_id, n_rows, n_tokens, n_known, train_tokens, base_score, score), a row per distinct id and text.

    ``training`` is a condition on the rows of ``docs`` (doc_id, text); ``n_rows`` says how often a row occurs.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.expr(training), F.lit(True)).alias("train"), "text")
    words = stored(rows.where("train").mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), *(F.count_if(F.col("c") == r).alias(f"n{r}") for r in range(1, K + 2))).first()
    n, v, d1 = total.n, total.v, discounts([0, *(total[f"n{r}"] for r in range(1, K + 2))])
    low = words.agg(F.sum(F.expr(_kept_sql("c", d1))).alias("kept")).first().kept or 0.0
    unknown = 1 - low / n if n else 1.0
    top = words.orderBy(F.desc("c"), "w").limit(HEAVY).toArrow()
    heavy = Heavy(top.column(0).to_numpy().astype(np.uint64), top.column(1).to_numpy().astype(np.int64))
    p1 = kept(heavy.c, d1) / max(n, 1)
    n_train = words.where(F.col("w") == int(END.astype(np.int64))).select("c").first()
    n_train = n_train.c if n_train else 0
    coded = words.select(F.col("w").bitwiseOR(F.lit(-(1 << 63))).alias("w"), "c")

    tokens = stored(rows.select("key", "train", "text").mapInArrow(partial(_tokens, heavy), TOKENS), "tokens")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_tokens = tokens.where("w is null").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    parts = max(shuffles, all_tokens // PART + 1)
    found = rows.select("key", "train", "text").mapInArrow(partial(_pairs, heavy, parts), BLOCK).repartition(parts, "part")
    found = stored(found.mapInArrow(partial(_parts, heavy, p1, n_train), FOUND), "pairs")

    counts = found.where("kind = 6").agg(*(F.coalesce(F.sum(f"k{r}"), F.lit(0)).alias(f"k{r}") for r in range(1, K + 2))).first()
    d2 = discounts([0, *counts])
    # what histories leave, and the own probability of what was seen after them
    p = F.expr(f"({_kept_sql('c', d1)}) / {float(max(n, 1))!r}D")
    rare = found.where("kind = 4").select("h", "w").join(coded, "w").select("h", F.lit(0.0).alias("left"), p.alias("sp"), F.lit(None).cast("long").alias("c"))
    left = sum((F.col(f"k{r}") * (r * (1 - d2[r - 1])) for r in range(1, K + 1)), F.col(f"k{K + 1}") * SLIP)
    heads = found.where("kind = 3").select("h", left.alias("left"), F.col("x").alias("sp"), F.col("n").alias("c"))
    alpha = (heads.union(rare).groupBy("h").agg(F.sum("left").alias("left"), F.sum("sp").alias("sp"), F.max("c").alias("c"))
             .select("h", F.log10(F.col("left") / F.col("c") / (1 - F.col("sp"))).alias("alpha")))

    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    shape = ["key", "rows", "tokens", "known", "base", "score"]
    whole = tokens.where("w is null").select("key", F.lit(1).cast("long"), "tokens", "known", "base", -F.col("hist") - math.log10(max(n_train, 1)))
    c = F.coalesce("c", zero)
    others = tokens.where("w is not null").join(coded, "w", "left").select(
        "key", zero, zero, F.when(c > 0, F.col("n")).otherwise(zero), F.col("n") * F.log10(c + 1.0), F.when(c > 0, -F.col("nh") * F.log10(c.cast("double"))).otherwise(none))
    seen = found.where("kind = 1").select("key", zero, zero, zero, none, sum((F.col(f"k{r}") * math.log10(d2[r - 1]) for r in range(1, K + 1)), F.col("x")))
    after = found.where("kind = 2").join(alpha, "h").select("key", zero, zero, zero, none, F.col("n") * F.col("alpha"))
    own = F.when(c > 0, F.log10(F.when(c > 0, p).otherwise(1.0))).otherwise(math.log10(unknown) if unknown > 0 else -99.0)
    ends = found.where("kind = 5").join(coded, "w", "left").select("key", zero, zero, zero, none, F.col("n") * own)
    parts_ = [x.toDF(*shape) for x in (whole, others, seen, after, ends)]
    every = parts_[0]
    for x in parts_[1:]:
        every = every.union(x)
    sums = every.groupBy("key").agg(*(F.sum(x).alias(x) for x in shape[1:]))
    per = sums.select("key", "rows", (F.col("tokens") / F.col("rows")).cast("long").alias("n_tokens"), (F.col("known") / F.col("rows")).cast("long").alias("n_known"),
                      F.lit(n).cast("long").alias("train_tokens"), (F.col("base") / F.col("rows")).alias("base"), (F.col("score") / F.col("rows")).alias("score"))
    per = per.select("key", "n_tokens", "n_known", "train_tokens", (F.col("base") - F.col("n_tokens") * math.log10(n + v + 1)).alias("base_score"), "score")
    ids = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"))
    return ids.join(per, "key").drop("key")
