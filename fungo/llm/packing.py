"""Packing documents into training sequences by lexical retrieval.

Documents are tokenized where they are read and written as token ids. Document frequencies
and the mean length are counted over all of them and written as a table (a row a token of
the vocabulary), so BM25 weights are those of the whole corpus. Documents are then dealt
into shards of about ``SHARD`` bytes by content: a sample of one document a shard's worth
of text, at most ``MOST``, leads (their ``PROFILE`` heaviest tokens are broadcast), every
document goes to the leader it scores highest by BM25, and a leader with more than a shard
of documents has them dealt again among leaders of its own, ``ROUNDS`` times in all. What is
still too large then, such as copies, is dealt by a hash of id and text; small groups of
sibling leaders share a shard.

Each shard holds a BM25 inverted index over token ids of its documents. A seed document
opens a window; the index ranks the shard's unused documents by all tokens of the seed,
and they fill the window in that order. A document that does not fit is cut; what is left
of it opens the next window and is its seed. Where no unused document shares a token, the
next unused one by id follows. Neighbours are thus looked up in a shard, not in all shards:
README gives the share of the corpus-wide neighbours that this finds.

So all windows are full, but for the last one of each shard, which is cut at powers of
two (1500 tokens become 1024, 256, 128, 64, 16, 8 and 4): those need no padding.

Tokens are 16-bit numbers on the way to their shard if the vocabulary allows. Words are
tokenized once a task and remembered; the tokenizer's patterns never reach across blanks.

Edge cases: a null or empty text is the one closing token. A text longer than a window
spans several. Rows that repeat are packed one by one; rows that repeat id and text for
more than a shard are dealt by their place in the table. Without documents there are no
pieces. But for such rows, results depend on ids and texts alone, not on partitions.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fungo.llm.common import chunks, stored, texts

LENGTH = 4096
SHARD = 6 << 20
MOST = 256
PROFILE = 256
ROUNDS = 3
POSTINGS = 1 << 18
NEAREST = 32
END = 2
K1, B = 1.2, 0.75
MEMO = 300_000
LONG = 10
#: A full stop or comma behind anything but a blank, a digit or a letter that stays one when lower-cased. Other white space is a mark too.
MARKS = re.compile(r"[^ 0-9A-Za-zÀ-ÖØ-öø-įı-ɏ][.,] ")
#: Words of small Latin-1 letters, digits and marks, without those of contractions and special tokens; the tokenizer cuts them into these parts.
PLAIN = re.compile(r"[a-zß-öø-ÿ0-9!-&(-/:;=-@\[-`{}~]*")
CUTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:;=-@\[-`{}~]+")

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Token ids of texts as packed unsigned integers.

    Words are remembered until there are ``MEMO`` of them. So that there are fewer, texts of
    Latin-1 characters are lower-cased first, as the tokenizer does, and full stops and commas
    that end words become words of their own, unless the text has one behind another mark:
    behind letters and digits the tokenizer cuts there too. A word of ``PLAIN`` characters is
    cut as the tokenizer cuts it and given to its model; others go through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known = _Words(self.tokenizer, "H" if self.kind.itemsize == 2 else "I")
        self.end = np.array([END], self.kind).tobytes()

    def __call__(self, items: list[bytes]) -> list[bytes]:
        known, out = self.known, []
        at = known.__getitem__
        for x in items:
            text = x.decode("utf-8", "replace")
            if text.isascii() or _is_latin(text):
                text = text.lower()
            text = text.replace("\n", " ") + " "
            if not MARKS.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
            out.append(b"".join(map(at, text.split(" "))) + self.end)
            if len(known) > MEMO:
                known.clear()
        return out


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Words(dict):
    """Packed token ids of words; those of more than ``LONG`` characters seldom come again and are not remembered."""

    def __init__(self, tokenizer, code: str):
        super().__init__()
        self.tokenizer, self.code = tokenizer, code
        # what the tokenizer makes of letters that are not ASCII
        self.letters = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}

    def __missing__(self, word: str) -> bytes:
        plain = word.isascii() and word.isalpha() and word.islower()
        if plain or PLAIN.fullmatch(word):
            ids, tokenize = [], self.tokenizer.model.tokenize
            for part in (word,) if plain else CUTS.findall(word):
                ids += [t.id for t in tokenize(part if part.isascii() else part.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        found = array(self.code, ids).tobytes()
        if len(word) <= LONG:
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


ENCODED = "doc_id long, ids binary, hash long, token int, df long, docs long, size long"


def _encode(path: str, batches):
    """Rows of documents (id, token ids, hash, size) and of tokens (token, documents that hold it); token -1 has the documents and all their tokens."""
    encoder, names = _encoder(path), [x.split()[0] for x in ENCODED.split(", ")]
    df, n, size = np.zeros(encoder.tokenizer.get_vocab_size() + 1, np.int64), 0, 0
    for b in batches:
        for k in range(0, b.num_rows, 1000):
            items, own = texts(b.column(1).slice(k, 1000)), b.column(0).slice(k, 1000)
            for i, j in chunks(items):
                found = encoder(items[i:j])
                sizes = np.array([len(x) // encoder.kind.itemsize for x in found])
                _, token = _distinct(np.frombuffer(b"".join(found), encoder.kind), sizes)
                df += np.bincount(token, minlength=len(df))
                n, size = n + j - i, size + int(sizes.sum())
                none = pa.nulls(j - i)
                signs = [int(np.uint64(xxhash.xxh3_64_intdigest(x)).astype(np.int64)) for x in found]
                yield pa.RecordBatch.from_arrays([own.slice(i, j - i), pa.array(found, pa.binary()), pa.array(signs, pa.int64()), none.cast(pa.int32()), *[none.cast(pa.int64())] * 2, pa.array(sizes, pa.int64())], names)
    if n:
        token = np.flatnonzero(df)
        none, no = pa.nulls(len(token) + 1), np.zeros(len(token), np.int64)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(np.r_[-1, token].astype(np.int32)),
                                          pa.array(np.r_[0, df[token]]), pa.array(np.r_[n, no]), pa.array(np.r_[size, no])], names)


def _distinct(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, token) without repeats, in order, of documents of these sizes that follow each other."""
    wide = ids.itemsize > 2 or len(sizes) > 1 << 16
    kind, bits = (np.uint64, 32) if wide else (np.uint32, 16)
    key = np.repeat(np.arange(len(sizes), dtype=kind) << kind(bits), sizes)
    key |= ids
    key.sort()
    key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
    return (key >> kind(bits)).astype(np.int32), (key & kind((1 << bits) - 1)).astype(np.int32)


class Corpus:
    """What BM25 needs to know of all documents: the weight of each token and the mean length."""

    def __init__(self, token: np.ndarray, df: np.ndarray, docs: int, size: int):
        self.idf, self.mean = np.zeros(int(token.max(initial=0)) + 1), size / max(docs, 1)
        self.idf[token] = np.log1p((docs - df + 0.5) / (df + 0.5))

    def weights(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The distinct tokens of a document and their BM25 weights."""
        t, tf = np.unique(ids, return_counts=True)
        return t, self.idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / self.mean))


def _profiles(kind: np.dtype, corpus: Corpus, batches):
    """The heaviest tokens of documents that lead, with their weights."""
    for b in batches:
        terms, weights = [], []
        for x in b.column(2).to_pylist():
            t, w = corpus.weights(np.frombuffer(x, kind).astype(np.int64))
            top = np.lexsort((t, -w))[:PROFILE]
            terms.append(t[top])
            weights.append(w[top])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(terms, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.float64()))], ["grp", "place", "terms", "weights"])


class Leaders:
    """The leaders, given by profiles, that documents are dealt to; ``at`` is the number of the first one's group."""

    def __init__(self, profiles: list[tuple[list, list]], at: int):
        term = np.concatenate([t for t, _ in profiles])
        order = np.argsort(term, kind="stable")
        self.doc = np.repeat(np.arange(len(profiles)), [len(t) for t, _ in profiles])[order].astype(np.int32)
        self.weight = np.concatenate([w for _, w in profiles])[order]
        self.terms, first = np.unique(term[order], return_index=True)
        self.first = np.r_[first, len(term)]
        self.n, self.at = len(profiles), at

    def of(self, doc: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
        """The leader with the highest score for each of ``n`` documents, the first of several; their tokens are those of ``_distinct``."""
        i = np.minimum(np.searchsorted(self.terms, token), len(self.terms) - 1)
        on = self.terms[i] == token
        i, doc, out = i[on], doc[on], np.zeros(n, np.int64)
        ends = np.r_[0, np.cumsum(self.first[i + 1] - self.first[i])]
        cuts = np.searchsorted(doc, np.arange(n + 1))
        a = 0
        while a < n:
            # some documents at a time, so that their postings and scores stay small
            b = min(max(a + 1, int(np.searchsorted(ends[cuts], ends[cuts[a]] + POSTINGS, "right")) - 1), a + max(1, POSTINGS // self.n), n)
            own = slice(cuts[a], cuts[b])
            counts = self.first[i[own] + 1] - self.first[i[own]]
            at = np.repeat(self.first[i[own]] - (ends[own] - ends[cuts[a]]), counts) + np.arange(ends[cuts[b]] - ends[cuts[a]])
            place = np.repeat((doc[own] - a) * self.n, counts) + self.doc[at]
            out[a:b] = np.bincount(place, self.weight[at], (b - a) * self.n).reshape(b - a, self.n).argmax(1)
            a = b
        return out


def _rows_of(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows one after another, and where each row starts."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1] // kind.itemsize
    return np.frombuffer(column.buffers()[2] or b"", kind), first


def _deal(kind: np.dtype, rounds: list[dict[int, Leaders]], keep: bool, batches):
    """Documents with the group that each goes to, round by round; a round has leaders of every group that was too large."""
    names = ["doc_id", *(["ids"] if keep else []), "hash", "size", "grp"]
    for whole in batches:
        for k in range(0, whole.num_rows, 1000):
            b = whole.slice(k, 1000)
            ids, first = _rows_of(b.column(1), kind)
            sizes = np.diff(first)
            doc, token = _distinct(ids[first[0]:first[-1]], sizes)
            cuts, grp = np.searchsorted(doc, np.arange(len(sizes) + 1)), np.zeros(len(sizes), np.int64)
            for leaders in rounds:
                before, order = grp.copy(), np.argsort(grp, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(before[order])) + 1):
                    own = leaders.get(int(before[part[0]])) if len(part) else None
                    if own is not None:
                        counts = cuts[part + 1] - cuts[part]
                        at = np.repeat(cuts[part] - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
                        grp[part] = own.at + own.of(np.repeat(np.arange(len(part)), counts), token[at], len(part))
            yield pa.RecordBatch.from_arrays([b.column(0), *([b.column(1)] if keep else []), b.column(2), b.column(3), pa.array(grp)], names)


class Index:
    """BM25 over the token ids of a shard's documents, with the weights of ``corpus``."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        n = len(docs)
        sizes = np.array([len(d) for d in docs])
        key = np.repeat(np.arange(n) << 32, sizes) | np.concatenate(docs).astype(np.int64)
        key.sort()
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        tf, key = np.diff(np.r_[first, len(key)]), key[first]
        doc, term = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)
        del key, first
        weight = corpus.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / corpus.mean))
        self.first = np.searchsorted(doc, np.arange(n + 1))
        df = np.bincount(term)
        at = np.cumsum(df > 0, dtype=np.int32)[term] - 1
        self.at, self.df = at, df[df > 0]
        order = np.argsort(at, kind="stable")
        self.post_doc, self.post_weight, self.post_first = doc[order], weight[order], np.r_[0, np.cumsum(self.df)]
        self.n = n

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """Unused documents that share a token with the seed, the best first."""
        at = self.at[self.first[seed]:self.first[seed + 1]]
        at = at[self.df[at] > 0]  # tokens of used documents find nobody
        if not len(at):
            return
        spans = list(map(slice, self.post_first[at].tolist(), self.post_first[at + 1].tolist()))
        score = np.bincount(np.concatenate([self.post_doc[s] for s in spans]), np.concatenate([self.post_weight[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        score = score[found]
        if len(found) > 4 * NEAREST:
            # a window seldom asks for more than these
            on = score >= np.partition(score, -NEAREST)[-NEAREST]
            yield from found[on][np.argsort(-score[on], kind="stable")].tolist()
            found, score = found[~on], score[~on]
        yield from found[np.argsort(-score, kind="stable")].tolist()

    def shrink(self, unused: np.ndarray):
        """Leaves out the postings of documents that are used."""
        on = unused[self.post_doc]
        term = np.repeat(np.arange(len(self.df)), self.df)[on]
        self.post_doc, self.post_weight = self.post_doc[on], self.post_weight[on]
        self.df = np.bincount(term, minlength=len(self.df))
        self.post_first = np.r_[0, np.cumsum(self.df)]


def order_of(docs: list[np.ndarray], corpus: Corpus, length: int = LENGTH) -> list[int]:
    """The order in which documents fill the windows one after another."""
    index, unused, out, filled, following = Index(docs, corpus), np.ones(len(docs), bool), [], 0, 0
    seed, near, held = -1, iter(()), len(docs)
    for left in range(len(docs), 0, -1):
        if 4 * left < 3 * held:
            held = left
            index.shrink(unused)
        nxt = next((d for d in near if unused[d]), None) if filled else None
        if nxt is None:
            while not unused[following]:
                following += 1
            nxt, seed = following, -1
        unused[nxt] = False
        out.append(nxt)
        total = filled + len(docs[nxt])
        filled = total % length
        if filled and (seed < 0 or total > length):
            seed, near = nxt, index.neighbours(nxt, unused)
    return out


def _bounds(total: int, length: int) -> np.ndarray:
    """Starts of the sequences over ``total`` tokens, and the end."""
    full, rest = divmod(total, length)
    tail = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.cumsum([0, *[length] * full, *tail])


def _pack(length: int, kind: np.dtype, corpus: Corpus, key, table: pa.Table) -> pa.Table:
    """Pieces of one shard."""
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    docs = [np.frombuffer(r[1], kind) for r in rows]
    order = order_of(docs, corpus, length)
    bounds = _bounds(sum(map(len, docs)), length)
    shard, out, at, seq = key[0].as_py(), [], 0, 0
    for d in order:
        ids, start = docs[d].astype("<u4"), 0
        while start < len(ids):
            offset = at - int(bounds[seq])
            n = min(len(ids) - start, int(bounds[seq + 1]) - at)
            out.append((rows[d][0], start, n, zlib.crc32(ids[start:start + n].tobytes()), len(ids), (shard << 32) + seq, offset))
            start, at = start + n, at + n
            seq += at == bounds[seq + 1]
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*out)], names)


DEALT = "doc_id long, ids binary, hash long, size long, grp long"
#: Token ids are written twice.
PACKED = {"compression": "zstd"}


def dealt(rows: DataFrame, kind: np.dtype, corpus: Corpus, shard_tokens: int) -> tuple[list[dict[int, Leaders]], DataFrame]:
    """Leaders of each round for ``rows`` (doc_id, ids, hash, size), and a table of (doc_id, hash, size, grp); that of the last round has the ids too."""
    spark, rounds, done, at = rows.sparkSession, [], set(), 1
    # all are one group at first
    places = rows.select("doc_id", "hash", "size", F.lit(0).cast("long").alias("grp"))
    while True:
        if rounds:
            keep = len(rounds) == ROUNDS
            places = stored(rows.mapInArrow(partial(_deal, kind, rounds, keep), DEALT if keep else DEALT.replace("ids binary, ", "")), "places", **PACKED if keep else {})
        if len(rounds) == ROUNDS:
            return rounds, places
        sizes = places.groupBy("grp").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        large = [(r.grp, min(MOST, math.ceil(r.size / shard_tokens)), r.n) for r in sizes if r.size > shard_tokens and r.grp not in done]
        if not large:
            return rounds, places
        done |= {g for g, _, _ in large}
        # the texts of smallest hash lead, longer ones first; so many rows are looked at that there are enough
        wanted = spark.createDataFrame([(g, k, min(1 << 20, int((1 << 20) * 8 * (k + 8) / n) + 1)) for g, k, n in large], "grp long, want long, below long")
        some = (places.join(F.broadcast(wanted), "grp").where(F.pmod(F.xxhash64("hash"), F.lit(1 << 20)) < F.col("below"))
                .groupBy("grp", "hash", "want").agg(F.min("size").alias("size")))
        order = Window.partitionBy("grp").orderBy(F.col("size") < 64, F.xxhash64("hash"), "hash")
        some = some.withColumn("place", F.row_number().over(order)).where("place <= want").select("hash", "grp", "place")
        texts_ = rows.join(F.broadcast(some), "hash").groupBy("grp", "place").agg(F.min("ids").alias("ids"))
        profiles: dict[int, list] = {}
        for r in sorted(texts_.mapInArrow(partial(_profiles, kind, corpus), "grp long, place int, terms array<long>, weights array<double>").collect(), key=lambda r: (r.grp, r.place)):
            profiles.setdefault(r.grp, []).append((r.terms, r.weights))
        leaders = {}
        for g, found in sorted(profiles.items()):
            if len(found) > 1:
                leaders[g] = Leaders(found, at)
                at += len(found)
        if not leaders:
            return rounds, places
        rounds.append(leaders)


def shard_table(sizes: dict[int, int], limit: int) -> list[tuple[int, int, int]]:
    """(group, first shard, shards) of groups of these sizes; groups that follow each other share a shard while they fit."""
    out, shard, filled = [], 0, 0
    for g, size in sorted(sizes.items()):
        parts = max(1, -(-size // limit))
        if filled and (parts > 1 or filled + size > limit):
            shard, filled = shard + 1, 0
        out.append((g, shard, parts))
        shard, filled = (shard + parts, 0) if parts > 1 else (shard, filled + size)
    return out


def packed(docs: DataFrame, path: str, length: int = LENGTH, shard_bytes: int = SHARD) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), see ``PIECES``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = Encoder(path).kind
    rows = stored(docs.mapInArrow(partial(_encode, path), ENCODED), "encoded", **PACKED)
    counts = stored(rows.where("token is not null").groupBy("token").agg(*(F.sum(x).alias(x) for x in ("df", "docs", "size"))), "frequencies").toArrow()
    token, df = counts.column(0).to_numpy(), counts.column(1).to_numpy()
    n, size = (int(counts.column(i).to_numpy().sum()) for i in (2, 3))
    corpus = Corpus(token[token >= 0], df[token >= 0], n, size)
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shard_tokens = max(1, int(shard_bytes * size / max(total, 1)))
    rows = rows.where("token is null").select("doc_id", "ids", "hash", "size")
    rounds, places = dealt(rows, kind, corpus, shard_tokens)

    # what is still too large is dealt by a hash; rows that repeat id and text for more than a shard by their place
    groups = shard_table({r.grp: r.size for r in places.groupBy("grp").agg(F.sum("size").alias("size")).collect()}, shard_tokens)
    table = F.broadcast(docs.sparkSession.createDataFrame(groups, "grp long, first long, parts long"))
    rows = (places if "ids" in places.columns else rows.mapInArrow(partial(_deal, kind, rounds, True), DEALT)).join(table, "grp")
    mixed = F.xxhash64("doc_id", "hash")
    if any(parts > 1 for _, _, parts in groups):
        large = (places.join(table, "grp").where("parts > 1").groupBy("grp", mixed.alias("mixed")).agg(F.sum("size").alias("size"))
                 .where(F.col("size") > shard_tokens).select("grp", "mixed", F.lit(True).alias("large")))
        rows = rows.withColumn("mixed", mixed).withColumn("place", F.monotonically_increasing_id()).join(F.broadcast(large), ["grp", "mixed"], "left")
        mixed = F.when(F.col("large"), F.xxhash64("mixed", "place")).otherwise(F.col("mixed"))
    rows = rows.select((F.col("first") + F.pmod(mixed, F.col("parts"))).alias("shard"), "doc_id", "ids")

    def pack(key, table):
        return _pack(length, kind, corpus, key, table)

    return rows.groupBy("shard").applyInArrow(pack, PIECES)
