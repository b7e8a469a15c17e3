"""Exact duplicates by an index of cuckoo filters over live digests.

Texts are equal when they are identical without their blanks. A digest is the 64-bit hash
of such a text; filters hold 16-bit marks of digests in buckets of four, each mark in one
of two buckets, so that marks can be inserted and deleted. A digest that a filter does not
know is new without any look at content. One that it may know is verified: its text is
compared with the content that is stored under the digest, so neither a false hit nor two
texts of one digest are ever taken for equal. When an insertion finds no room, the filter
is built anew with twice the buckets from the digests that are stored.

``insert`` works in two levels, both by such filters:

1. Where the rows are read, a task keeps a filter and content of ``HOLD`` bytes, then starts
   afresh. Each text it meets first stands for its copies there, so a group of copies of any
   size sends on a text a task, not a text a row.
2. These texts are exchanged once, by shard of their digest. A task reads its shards one
   after another: the filter, digests of live texts, content of the digests that the
   filter may know, and then the new texts, which join a class or open one.

Rows find their class through the text that stands for them, so no join has a hot key.
``delete`` takes rows out; a digest leaves the filter with the last text that has it, and a
class whose row to keep is gone gets another. Every step reads and writes tables in the
shared folder: rows and content are only added to, classes and filters are written anew.

Of a class the row with the most code points in its original text stays, then the smallest
id (no id is larger than any), then the row read first.

Edge cases: a null text counts as empty, and all texts without characters other than
blanks are one class. Very long texts are compared whole. Repeated rows are rows of their
own. Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from fungo.llm.common import stored, texts

BLANKS = b" \t\n\r\x0b\x0c"
#: Bytes of content that a reading task keeps.
HOLD = 32 << 20
#: Bytes of text, and live digests, of a shard.
SHARD, LIVE = 16 << 20, 1 << 20
KICKS = 200
MASK = (1 << 64) - 1


def _mix(x: int) -> int:
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


class CuckooFilter:
    """Marks of digests, four a bucket; the number of buckets is a power of two."""

    def __init__(self, buckets: int = 64, slots: bytes | None = None):
        self.buckets = buckets
        self.slots = array("H", slots if slots is not None else bytes(8 * buckets))

    def _places(self, digest: int) -> tuple[int, int, int]:
        x = _mix(digest & MASK)
        mark = (x >> 48) or 1
        i = x & (self.buckets - 1)
        return mark, i, self._other(i, mark)

    def _other(self, i: int, mark: int) -> int:
        return i ^ (_mix(mark) & (self.buckets - 1))

    def _replace(self, i: int, old: int, new: int) -> bool:
        for k in range(4 * i, 4 * i + 4):
            if self.slots[k] == old:
                self.slots[k] = new
                return True
        return False

    def __contains__(self, digest: int) -> bool:
        mark, i, j = self._places(digest)
        return mark in self.slots[4 * i:4 * i + 4] or mark in self.slots[4 * j:4 * j + 4]

    def insert(self, digest: int) -> bool:
        """False when there was no room; a mark may then be lost, so the filter must be built anew."""
        mark, i, j = self._places(digest)
        if self._replace(i, 0, mark) or self._replace(j, 0, mark):
            return True
        for turn in range(KICKS):
            k = 4 * j + turn % 4
            mark, self.slots[k] = self.slots[k], mark
            j = self._other(j, mark)
            if self._replace(j, 0, mark):
                return True
        return False

    def delete(self, digest: int) -> bool:
        mark, i, j = self._places(digest)
        return self._replace(i, mark, 0) or self._replace(j, mark, 0)

    @classmethod
    def of(cls, digests, buckets: int = 64) -> CuckooFilter:
        """A filter of all ``digests``, with twice the buckets until there is room."""
        while True:
            made = cls(buckets)
            if all(map(made.insert, digests)):
                return made
            buckets *= 2


class _Classes:
    """Texts of one shard or task: a filter, stored digests, and content under each digest."""

    def __init__(self, marks: CuckooFilter | None = None, digests=()):
        self.marks, self.digests, self.content = marks or CuckooFilter(), list(digests), {}

    def place(self, digest: int, text: bytes) -> list | None:
        """The class of this text; its digest is entered where it is new, and None returned, when there is none."""
        if digest in self.marks:
            for c in self.content.get(digest, ()):
                if c[1] == text:
                    return c
            if digest in self.content:
                return None
        self.digests.append(digest)
        if not self.marks.insert(digest):
            self.marks = CuckooFilter.of(self.digests, 2 * self.marks.buckets)
        return None

    def add(self, digest: int, c: list) -> list:
        self.content.setdefault(digest, []).append(c)
        return c


def _better(n: int, doc, uid: int) -> tuple:
    return -n, doc is None, doc or 0, uid


LOCAL = "kind int, uid long, doc_id long, n_chars long, sha binary, rep long, digest long, size long, text binary, n long"
SHARDED = "kind int, class long, digest long, rep long, n long, n_chars long, doc_id long, uid long, text binary, shard int, buckets long, slots binary, size long"
KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], list(names))


def _local(hold: int, bits: int, batches):
    """Rows with the text that stands for them (kind 0), and these texts with their counts and best rows (kind 1)."""
    seen, held = _Classes(), 0

    def flush():
        rows = []
        for digest, own in seen.content.items():
            rows.extend((1, c[3][3], None if c[3][1] else c[3][2], -c[3][0], None, c[0], digest, len(c[1]), c[1], c[2]) for c in own)
        return _batch(LOCAL, rows)

    for b in batches:
        column, rows = b.column(1), []
        sizes = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
        for doc, text, n, uid in zip(b.column(0).to_pylist(), texts(column), sizes, b.column(2).to_pylist()):
            text = text.translate(None, BLANKS)
            digest = xxhash.xxh3_64_intdigest(text) & ((1 << bits) - 1)
            digest -= digest >> 63 << 64
            c, best = seen.place(digest, text), _better(n, doc, uid)
            if c is None:
                c = seen.add(digest, [uid, text, 0, best])
                held += len(text) + 200
            c[2] += 1
            c[3] = min(c[3], best)
            rows.append((0, uid, doc, n, hashlib.sha256(text).digest(), c[0], None, None, None, None))
            if held > hold:
                yield flush()
                seen, held = _Classes(), 0
        yield _batch(LOCAL, rows)
    yield flush()


def _sharded(batches):
    """Shards in turn, each by tag: 0 filter, 1 live digests, 2 content that may be known, 3 new texts."""
    shard, seen, found, opened, touched = None, None, [], [], {}

    def close():
        rows = found + opened
        rows += [(1, c[0], d, None, c[2], -c[3][0], None if c[3][1] else c[3][2], c[3][3], *[None] * 5) for d, c in touched.values()]
        rows.append((3, *[None] * 8, shard, seen.marks.buckets, seen.marks.slots.tobytes(), None))
        return _batch(SHARDED, rows)

    for b in batches:
        for at, tag, cls, digest, rep, n, n_chars, doc, uid, text, buckets, slots in zip(*(c.to_pylist() for c in b.columns)):
            if at != shard:
                if shard is not None:
                    yield close()
                shard, seen, found, opened, touched = at, _Classes(), [], [], {}
            if tag == 0:
                seen.marks = CuckooFilter(buckets, slots)
            elif tag == 1:
                seen.digests.append(digest)
            elif tag == 2:
                seen.add(digest, [cls, text, n, _better(n_chars, doc, uid)])
            else:
                c, best = seen.place(digest, text), _better(n_chars, doc, uid)
                if c is None:
                    c = seen.add(digest, [rep, text, 0, best])
                    opened.append((2, rep, digest, *[None] * 5, text, shard, None, None, len(text)))
                c[2] += n
                c[3] = min(c[3], best)
                touched[c[0]] = digest, c
                found.append((0, c[0], None, rep, *[None] * 9))
    if shard is not None:
        yield close()


def _filter_of(key: tuple[pa.Scalar, ...], digests: pa.Table) -> pa.Table:
    own = CuckooFilter.of(digests.column("digest").to_pylist())
    return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([own.buckets], pa.int64()), pa.array([own.slots.tobytes()])], ["shard", "buckets", "slots"])


def _known(filters: pa.Table, digests: pa.Table) -> pa.Table:
    """Digests that their shard's filter may know."""
    asked = digests.column("digest").to_pylist()
    if filters.num_rows:
        own = CuckooFilter(filters.column("buckets")[0].as_py(), filters.column("slots")[0].as_py())
        asked = [d for d in asked if d in own]
    else:
        asked = []
    return pa.table([pa.array(asked, pa.int64())], ["digest"])


def _less(filters: pa.Table, digests: pa.Table) -> pa.Table:
    """The shard's filter without some digests."""
    if not filters.num_rows:
        return filters.select(["shard", "buckets", "slots"])
    own = CuckooFilter(filters.column("buckets")[0].as_py(), filters.column("slots")[0].as_py())
    for d in digests.column("digest").to_pylist():
        own.delete(d)
    return pa.table([filters.column("shard"), filters.column("buckets"), pa.array([own.slots.tobytes()])], ["shard", "buckets", "slots"])


class CuckooIndex:
    """Live rows, their classes of equal texts, the content of each class, and a filter of digests per shard.

    ``bits`` shortens digests and ``hold`` what reading tasks keep; results stay the same.
    """

    def __init__(self, spark: SparkSession, bits: int = 64, hold: int = HOLD, shard: int = SHARD, live: int = LIVE):
        self.spark, self.bits, self.hold, self.shard_bytes, self.live = spark, bits, hold, shard, live
        empty = partial(spark.createDataFrame, [])
        self.rows = empty("uid long, doc_id long, n_chars long, sha binary, rep long")
        self.reps = empty("rep long, class long")
        self.classes = empty("class long, digest long, n long, n_chars long, doc_id long, uid long")
        self.content = empty("class long, digest long, text binary, size long")
        self.filters = empty("shard int, buckets long, slots binary")
        self.shards, self.next_uid, self.steps = 0, 0, 0

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        # content is written twice on its way; it is packed tighter than other tables
        spark, old = self.spark, self.spark.conf.get("spark.sql.parquet.compression.codec")
        spark.conf.set("spark.sql.parquet.compression.codec", "zstd")
        try:
            return stored(df, f"{name}-{self.steps}")
        finally:
            spark.conf.set("spark.sql.parquet.compression.codec", old)

    def _shard(self):
        return F.pmod(F.col("digest"), F.lit(max(1, self.shards))).cast("int").alias("shard")

    def _fit(self, size: int) -> None:
        """Enough shards for ``size`` bytes of new texts and the digests that live; filters are built anew from stored keys when their number grows."""
        n = self.classes.count()
        need = max(size // self.shard_bytes, n // self.live) + 1
        if need <= self.shards:
            return
        self.shards = max(need, 2 * self.shards)
        if n:
            keys = self.classes.select("digest").distinct().select(self._shard(), "digest")
            self.filters = self._stored(keys.groupBy("shard").applyInArrow(_filter_of, "shard int, buckets long, slots binary"), "filters")

    def _maybe(self, digests: DataFrame) -> DataFrame:
        asked = digests.select("digest").distinct().select(self._shard(), "digest")
        return self.filters.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(_known, "digest long")

    def insert(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> CuckooIndex:
        """Every row of ``docs``, also ids and texts that the index has."""
        self.steps += 1
        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.monotonically_increasing_id() + F.lit(self.next_uid)).alias("uid"))
        read = self._stored(rows.mapInArrow(partial(_local, self.hold, self.bits), LOCAL), "read")
        size, top = read.agg(F.sum("size"), F.max("uid")).first()
        if top is None:
            return self
        self.next_uid = top + 1
        first = not self.shards
        self._fit(size or 0)
        new = read.where("kind = 1")
        none = {"class": "long", "rep": "long", "n": "long", "n_chars": "long", "doc_id": "long", "uid": "long", "text": "binary", "buckets": "long", "slots": "binary", "digest": "long"}

        def tagged(df: DataFrame, tag: int, shard=None) -> DataFrame:
            for c, kind in none.items():
                if c not in df.columns:
                    df = df.withColumn(c, F.lit(None).cast(kind))
            return df.select((shard if shard is not None else self._shard()).alias("shard"), F.lit(tag).alias("tag"), "class", "digest", "rep", "n", "n_chars", "doc_id", "uid", "text", "buckets", "slots")

        parts = tagged(new, 3)
        if not first:
            hits = self._maybe(new)
            known = self.content.drop("size").join(hits, "digest", "left_semi").join(self.classes.drop("digest"), "class")
            parts = parts.union(tagged(known, 2)).union(tagged(self.classes.select("digest").distinct(), 1)).union(tagged(self.filters, 0, F.col("shard")))
        parts = parts.repartition(self.shards, "shard").sortWithinPartitions("shard", "tag")
        out = self._stored(parts.mapInArrow(_sharded, SHARDED), "shards")
        touched = out.where("kind = 1").select(self.classes.columns)
        content, filters = out.where("kind = 2").select(self.content.columns), out.where("kind = 3").select(self.filters.columns)
        reps, members = out.where("kind = 0").select("rep", "class"), read.where("kind = 0").select(self.rows.columns)
        if first:
            self.classes, self.content, self.filters, self.reps, self.rows = touched, content, filters, reps, members
        else:
            self.classes = self._stored(self.classes.join(touched, "class", "left_anti").select(touched.columns).union(touched), "classes")
            self.filters = self._stored(self.filters.join(filters, "shard", "left_anti").union(filters), "filters")
            self.content, self.reps, self.rows = self.content.union(content), self.reps.union(reps), self.rows.union(members)
        return self

    def delete(self, ids: DataFrame) -> CuckooIndex:
        """Takes out all rows whose id is in the first column of ``ids``."""
        if not self.shards:
            return self
        self.steps += 1
        gone = ids.select(F.col(ids.columns[0]).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
        held = self.reps.join(self.rows.join(gone, "doc_id", "left_semi").select("rep").distinct(), "rep", "left_semi").select("class").distinct()
        held = self._stored(held, "held")
        self.rows = self._stored(self.rows.join(gone, "doc_id", "left_anti").select(self.rows.columns), "rows")
        order = F.struct("n_chars", F.col("doc_id").isNotNull().alias("has_id"), (-F.col("doc_id")).alias("low"), (-F.col("uid")).alias("early"))
        left = self.rows.join(self.reps.join(held, "class", "left_semi"), "rep").groupBy("class").agg(F.count("*").alias("n"), F.max(order).alias("b"))
        left = left.select("class", "n", F.col("b.n_chars"), (-F.col("b.low")).alias("doc_id"), (-F.col("b.early")).alias("uid"))
        anew = self.classes.select("class", "digest").join(left, "class").select(self.classes.columns)
        rest = self.classes.join(held, "class", "left_anti").select(self.classes.columns)
        before = self.classes.join(held, "class", "left_semi").select("digest").distinct()
        self.classes = self._stored(rest.union(anew), "classes")
        dead = before.join(self.classes, "digest", "left_anti").select(self._shard(), "digest")
        self.filters = self._stored(self.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInArrow(_less, "shard int, buckets long, slots binary"), "filters")
        self.content = self._stored(self.content.join(self.classes, "class", "left_semi").select(self.content.columns), "content")
        self.reps = self.reps.join(self.classes, "class", "left_semi").select("rep", "class")
        return self

    def decisions(self) -> DataFrame:
        """(doc_id, keep_id, group_size, kept, text_sha256) of every live row."""
        best = self.reps.join(self.classes.select("class", F.col("n").alias("group_size"), F.col("doc_id").alias("keep_id"), F.col("uid").alias("keep_uid")), "class")
        return self.rows.join(best, "rep").select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
