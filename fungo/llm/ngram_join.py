"""Jaccard self-join of documents on word shingles with a token-group matrix.

A document is the set of its distinct five-word shingles, as 64-bit hashes. Documents
with equal sets are one *class*. Two classes link if their Jaccard similarity is at least
3/4, and documents that reach each other by links form a component. ``links`` finds enough
links to connect every component, which is all that ``membership`` needs; ``all_links``
finds every link between classes, and ``pairs`` every pair of documents that link.

* **Groups.** Similar classes are put into groups first: classes with a common min-hash
  are compared with one leader, and those that pass the exact test are joined to it; in
  ``TURNS`` turns, with other leaders for those that are still apart. A last turn compares
  each class with the centre that most of its leading tokens point to: of the classes that
  have a token, the one with the fewest tokens that no other class has.
  What such links connect is a group; every other class is a group of its own.
* **Matrix.** With all shingles in one global order, rare ones first, two sets as similar
  as asked share one of their first n - ceil(3n/4) + 1 shingles. A group's token union is
  the union of these leading tokens of its members. It is stored as rows (token, group), one
  however many members have the token, with the smallest and largest size among them.
* **Bound.** Of two groups, the classes of the smaller one ask the larger. The leading
  tokens a class has in common with a group's union are counted; with what can be left
  beyond them they bound its overlap with every member. Only groups whose bound reaches
  the overlap that their smallest member would need are opened. Before anything is counted, the leading
  tokens that no other class has bound the size of what a class can link with (its reach).
* **Opening.** In an opened group the class meets the members that have one of its rarer tokens,
  of which they cannot lack all; the bounds hold for the pair too, and what remains is compared exactly, on whole texts.

For components nothing within a group is compared again, so large groups of near copies cost
a few comparisons each, not one per pair. ``all_links`` makes every class a group. Tokens of
many classes are dealt to several tasks by the class that asks.

The order of shingles affects cost, never results. It puts the ``FREQUENT`` most frequent
shingles last; they are counted where they occur at least ``OFTEN`` times among the
shingles that a task has at hand, equal sets once, and this list is all that is broadcast,
besides a bit table of fixed size that keeps texts nobody asks for out of the shuffle.

Very long texts are one set like any other and are never cut. Other columns are not read;
``one_of_each`` carries them whatever their names. Of equal texts, and in a component, the
smallest doc_id stands for the rest.

Edge cases: a null or empty text, or one without words, has no shingle and links with
nothing. A text of one to four words is one shingle. Copies are linked. Where rows repeat a
doc_id, each of their texts is a class and all of them belong to the id's component. Without
documents the result is empty.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from fungo.llm.common import WORD, WordHashes, chunks, free, stored, texts
from fungo.llm.components import components

WORDS = 5
BANDS = 4
TURNS = 2
FAR = 1 << 60
FREQUENT = 200_000
OFTEN = 4
HELD = 2_000_000
BITS = 1 << 26
PART_ROWS = 1_500_000
FAN = 256
SALTS = 64

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                  0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULT[0]
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, known: WordHashes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    w = known(text.lower().split())
    if not len(w):
        return w
    k = min(words, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * _MULT[1] + w[i:len(w) - k + 1 + i]
    return np.unique(_mix(h + np.uint64(k)))


def _sign(u: np.ndarray) -> int:
    """Fingerprint of a set, as a signed integer."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(u.tobytes())).astype(np.int64))


def _profiles(words: int, batches):
    """Rows of documents (id, size, fingerprint, min-hashes) and of frequent tokens (token, count)."""
    known, held, n_held, seen = WordHashes(), [], 0, set()
    names = ["doc_id", "n", "sig", "bands", "token", "count"]

    def frequent():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        on = counts >= OFTEN
        t, c = tokens[on].astype(np.int64), counts[on]
        none = pa.nulls(len(t))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())), pa.array(t), pa.array(c)], names)

    for b in batches:
        sizes, signs, bands = [], [], []
        for text in texts(b.column(1)):
            u = shingles(text, known, words)
            sizes.append(len(u))
            if len(u):
                signs.append(_sign(u))
                bands.append([int((u * m).min().astype(np.int64)) for m in _MULT[:BANDS]])
                if signs[-1] not in seen:
                    seen.add(signs[-1])
                    held.append(u)
                    n_held += len(u)
            else:
                signs.append(None)
                bands.append(None)
            if n_held >= HELD:
                yield frequent()
                held, n_held = [], 0
                seen.clear()
        none = pa.nulls(len(sizes)).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(signs, pa.int64()), pa.array(bands, pa.list_(pa.int64())), none, none], names)
    yield frequent()


PREFIX = ["token", "sig", "n", "end_rank", "end", "salt"]
PREFIX_DDL = ", ".join(f"{x} long" for x in PREFIX)


def _keep(n):
    """Overlap that a set of n needs at least."""
    return (3 * n + 3) // 4


def _kept(n):
    """The same as a column."""
    return F.floor((n * 3 + 3) / 4)


def _in_reach(size: str, reach: str):
    """Whether a class (n, reach) and another, or some member of a group, can link by what each has that no other class has."""
    return F.expr(f"({reach} = {FAR} or {size} <= reach) and (reach = {FAR} or {reach} >= n)")


def _prefixes(words: int, tokens: np.ndarray, rank: np.ndarray, batches):
    """(token, class, size, place of the last leading token in the order, salt) of the leading tokens of each set; a class once a task.

    Frequent tokens, which are known to be shared, have a salt; that of others is -1.
    """
    known, seen = WordHashes(), set()
    for b in batches:
        items = texts(b.column(0))
        for i, j in chunks(items):
            out_t, out_s, out_n, out_r, out_e, out_x = [], [], [], [], [], []
            for text in items[i:j]:
                u = shingles(text, known, words)
                if not len(u) or (s := _sign(u)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(s)
                order = np.zeros(len(u), np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, u), len(tokens) - 1)
                    order = np.where(tokens[at] == u, rank[at], 0)
                at = np.argsort(order, kind="stable")[:len(u) - _keep(len(u)) + 1]
                first = u[at]
                out_t.append(first)
                out_x.append(np.where(order[at] > 0, s % SALTS, -1))
                for out, v in ((out_s, s), (out_n, len(u)), (out_r, order[at[-1]]), (out_e, (first[-1] ^ np.uint64(1 << 63)).astype(np.int64))):
                    out.append(np.full(len(first), v, np.int64))
            if out_t:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_t, out_s, out_n, out_r, out_e, out_x)], PREFIX)


def _shared(batches):
    """Rows of a partition, once each, whose token is frequent or occurs in more than one class."""
    parts = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    columns = [np.concatenate(x) for x in zip(*parts)]
    order = np.lexsort((columns[1], columns[0]))
    t, s = columns[0][order], columns[1][order]
    order = order[np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])]]
    t = columns[0][order]
    same = t[1:] == t[:-1]
    order = order[np.r_[False, same] | np.r_[same, False] | (columns[5][order] >= 0)]
    for i in range(0, len(order), 65536):
        yield pa.RecordBatch.from_arrays([pa.array(c[order[i:i + 65536]]) for c in columns], PREFIX)


def _verify(words: int, batches):
    """Exact links of a partition sorted by (centre, salt, other); the centre's own text comes first."""
    known, centre, base = WordHashes(), None, None
    for b in batches:
        found = ([], [])
        cs, salts, others, own = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts(b.column(3))
        for c, salt, other, text in zip(cs, salts, others, own):
            u = shingles(text, known, words)
            if other is None:
                centre, base = (c, salt), u
                continue
            if centre != (c, salt):
                raise ValueError("a pair has come before the text of its centre")
            both = len(u) + len(base) - len(np.union1d(u, base))
            if 100 * both >= 75 * (len(u) + len(base) - both):
                found[0].append(c)
                found[1].append(other)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], ["u", "v"])


def _wanted(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _mix(ids.astype(np.uint64)) & np.uint64(BITS - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bit_words(batches):
    for b in batches:
        at = _mix(b.column(0).to_numpy().astype(np.uint64)) & np.uint64(BITS - 1)
        word = (at >> np.uint64(6)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << (at & np.uint64(63))).astype(np.int64))], ["word", "bits"])


def _asked_for(bits: np.ndarray, batches):
    for b in batches:
        yield b.filter(pa.array(_wanted(bits, b.column(0).fill_null(0).to_numpy())))


class NgramJoin:
    """The join over ``docs`` (columns doc_id and text, others are ignored)."""

    def __init__(self, docs: DataFrame, words: int = WORDS):
        self.spark, self.words = docs.sparkSession, words
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        rows = stored(self.docs.mapInArrow(partial(_profiles, words), "doc_id long, n long, sig long, bands array<long>, token long, count long"), "profiles")
        self.profiles = rows.where("n is not null").select("doc_id", "n", "sig", "bands")
        self.tokens = rows.where("token is not null").select("token", "count")
        # a class of equal sets; its node is its smallest document, or its fingerprint where an id may stand for several texts
        classes = self.profiles.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        self.classes = stored(classes.withColumn("node", F.col("sig" if self.repeated_ids else "rep")), "classes")

    def _bits(self, ids: DataFrame) -> np.ndarray:
        """Bit table of fixed size over ids; a bit set by mistake only costs time."""
        words = ids.mapInArrow(_bit_words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        out = np.zeros(BITS >> 6, np.uint64)
        out[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint64)
        return out

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of class nodes that link."""
        # pairs that share a node meet in one task; a node with many pairs is the centre of several
        pairs = pairs.select("u", "v")
        fans = pairs.groupBy("u").agg(F.ceil(F.count("*") / FAN).cast("int").alias("fan"))
        salted = pairs.join(fans, "u").select("u", F.pmod(F.xxhash64("v"), F.col("fan")).cast("int").alias("salt"), "v")
        sides = stored(salted.select(F.col("v").alias("_node"), "u", "salt", F.col("v").alias("other"))
                       .union(salted.select("u", "u", "salt", F.lit(None).cast("long")).distinct()), "sides")
        ids = sides.select("_node").distinct()
        if self.repeated_ids:
            ids = ids.join(self.classes, F.col("_node") == F.col("node")).select("rep").distinct()
        bits = self._bits(ids)
        # several rows may carry an id: those whose set is the class's own are meant
        found = self.docs.mapInArrow(partial(_asked_for, bits), "doc_id long, text string").where("doc_id is not null")
        if self.repeated_ids:
            found = (found.mapInArrow(partial(_with_sign, self.words), "doc_id long, text string, sig long")
                     .join(self.classes.select(F.col("rep").alias("doc_id"), "sig"), ["doc_id", "sig"], "left_semi").dropDuplicates(["sig"]).select(F.col("sig").alias("doc_id"), "text"))
        rows = sides.join(found, F.col("_node") == F.col("doc_id")).select("u", "salt", "other", "text")
        n = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), 1)
        rows = rows.repartition(n, "u", "salt").sortWithinPartitions("u", "salt", F.col("other").asc_nulls_first())
        return stored(rows.mapInArrow(partial(_verify, self.words), "u long, v long"), "links")

    @property
    def repeated_ids(self) -> bool:
        if not hasattr(self, "_repeated"):
            self._repeated = not self.profiles.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
        return self._repeated

    def leader_pairs(self, turn: int, groups: DataFrame | None) -> DataFrame:
        """Each class with the leader of each of its min-hashes, where sizes allow a link and no group holds both.

        The first leader is the smallest document; later turns draw others, so that a class
        which is not close enough to one leader meets another member.
        """
        bands = self.classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
        rank = F.lit(0).cast("long")
        bands = bands.withColumn("grp", F.col("node"))
        if groups is not None:
            rank = F.xxhash64("node", "band", F.lit(turn))
            bands = bands.drop("grp").join(groups.withColumnRenamed("component", "grp"), "node", "left").withColumn("grp", F.coalesce("grp", "node"))
        leaders = bands.groupBy("band", "key").agg(F.min(F.struct(rank.alias("rank"), "node", "n", "grp")).alias("lead"), F.min("grp").alias("a"), F.max("grp").alias("b")).where("a < b")
        return (bands.join(leaders.select("band", "key", "lead"), ["band", "key"]).where("grp <> lead.grp and 4 * least(n, lead.n) >= 3 * greatest(n, lead.n)")
                .select(F.col("lead.node").alias("u"), F.col("node").alias("v")).distinct())

    def leading(self) -> DataFrame:
        """Leading tokens of every class that others may have too.

        ``own`` counts the class's other leading tokens. Where its leading tokens reach into the frequent ones, those have all its
        rare tokens, so that no class of this kind with more than ``reach`` tokens can link with it; others have ``FAR``.
        """
        top = self.tokens.groupBy("token").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "token").limit(FREQUENT).toArrow()
        token, count = top.column(0).to_numpy().astype(np.uint64), top.column(1).to_numpy()
        order = np.argsort(token)
        total = self.profiles.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), int(total * 0.25 / PART_ROWS) + 1)
        rows = (self.docs.select("text").mapInArrow(partial(_prefixes, self.words, token[order], count[order]), PREFIX_DDL)
                .repartition(parts, "token", "salt").mapInArrow(_shared, PREFIX_DDL))
        rows = rows.join(self.classes.select("sig", "node"), "sig")
        rows = rows.withColumn("own", F.col("n") - _kept(F.col("n")) + 1 - F.count("*").over(Window.partitionBy("sig")))
        reach = F.when(F.col("end_rank") > 0, F.floor((4 * F.col("n") - 7 * F.col("own")) / 3)).otherwise(FAR)
        return stored(rows.select("token", "node", "n", "own", reach.alias("reach"), F.struct("end_rank", "end").alias("end")), "leading")

    def centre_pairs(self, leading: DataFrame, groups: DataFrame) -> DataFrame:
        """Each class with the centre that most of its leading tokens have, if the bounds may allow a link and no group holds both.

        A token's centre is the class with the fewest tokens of its own, such as the text that others are copies of.
        """
        rows = leading.join(groups, "node", "left").withColumn("grp", F.coalesce("component", "node")).drop("component")
        tokens = (rows.groupBy("token").agg(F.min(F.struct("own", "node", "n", "reach", "end", "grp")).alias("mid"), F.min("grp").alias("a"), F.max("grp").alias("b"))
                  .where("a < b").select("token", "mid"))
        met = rows.join(tokens, "token").where("grp <> mid.grp and 4 * least(n, mid.n) >= 3 * greatest(n, mid.n)").where(_in_reach("mid.n", "mid.reach"))
        met = met.groupBy("node", F.col("mid.node").alias("mid")).agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("mid.n").alias("size"))
        left = _kept(F.greatest("n", "size")) - 1
        met = met.where(F.col("met") + left >= F.ceil((F.col("n") + F.col("size")) * 3 / 7))
        return met.groupBy("node").agg(F.max(F.struct("met", "mid")).alias("best")).select(F.col("best.mid").alias("u"), F.col("node").alias("v"))

    def grouped(self, leading: DataFrame, groups: DataFrame | None) -> DataFrame:
        """The leading tokens with each class's group and how many classes that has; without ``groups`` each class is one."""
        if groups is None:
            return leading.withColumn("grp", F.col("node")).withColumn("weight", F.lit(1).cast("long"))
        weights = groups.groupBy("component").agg(F.count("*").alias("weight"))
        groups = groups.join(weights, "component").withColumnRenamed("component", "grp")
        rows = leading.join(groups, "node", "left").withColumn("grp", F.coalesce("grp", "node")).withColumn("weight", F.coalesce("weight", F.lit(1)))
        return stored(rows, "grouped")

    def matrix(self, leading: DataFrame) -> DataFrame:
        """Token-group matrix: a row per token of a group's union, of tokens that several groups have.

        ``lo`` and ``hi`` are the smallest and largest size of the members that have the token, ``far`` their longest reach, ``rows`` their number, ``one``
        and ``two`` the smallest and largest of them, ``last`` the latest end of their leading tokens; the token's askers
        are dealt to ``fan`` tasks.
        """
        union = leading.groupBy("token", "grp").agg(F.first("weight").alias("weight"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("reach").alias("far"),
                                                    F.min("node").alias("one"), F.max("node").alias("two"), F.max("end").alias("last"), F.count("*").alias("rows"))
        tokens = union.groupBy("token").agg(F.count("*").alias("groups"), F.ceil(F.sum("rows") / FAN).cast("int").alias("fan")).where("groups > 1")
        return stored(union.join(tokens.drop("groups"), "token"), "matrix")

    def opened(self, leading: DataFrame, matrix: DataFrame) -> DataFrame:
        """Classes (u, n, reach, end) with the groups (grp) whose bound on their overlap reaches what a member would need.

        ``least`` is the number of leading tokens that they must have in common with such a member.
        """
        asks = leading.join(matrix.select("token", "fan").distinct(), "token")
        asks = asks.select("token", F.pmod(F.xxhash64("node"), F.col("fan")).cast("int").alias("salt"), F.col("node").alias("u"), F.struct("weight", "grp").alias("own"), "n", "reach", "end")
        cells = matrix.select("token", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), "grp", "weight", "lo", "hi", "far", "one", "two", "last")
        # of two groups the classes of the smaller one ask
        met = asks.join(cells, ["token", "salt"]).where("own < struct(weight, grp) and 3 * lo <= 4 * n and 4 * hi >= 3 * n").where(_in_reach("lo", "far"))
        met = met.groupBy("u", "grp").agg(F.count("*").alias("met"), F.first("n").alias("n"), F.first("reach").alias("reach"), F.first("end").alias("end"), F.min("lo").alias("lo"),
                                          F.max("hi").alias("hi"), F.min("one").alias("one"), F.max("two").alias("two"), F.max("last").alias("last"))
        # members that end later leave what the class has beyond its leading tokens; those that end first, what they have
        left = F.when(F.col("end") > F.col("last"), _kept(F.col("hi"))).otherwise(_kept(F.greatest("n", "hi"))) - 1
        need = F.ceil((F.col("n") + F.greatest(F.col("lo"), _kept(F.col("n")))) * 3 / 7)
        return stored(met.where(F.col("met") + left >= need).select("u", "grp", "n", "reach", "end", "one", "two", F.greatest(need - left, F.lit(1)).alias("least")), "opened")

    def group_pairs(self, leading: DataFrame, groups: DataFrame | None) -> DataFrame:
        """Pairs of classes in different groups that the bounds of group and pair leave; without ``groups`` of all classes."""
        leading = self.grouped(leading, groups)
        matrix = self.matrix(leading)
        opened = self.opened(leading, matrix)
        # where one member alone has tokens of the class, the group's bound is the pair's
        alone = opened.where("one = two").select("u", F.col("one").alias("v"))
        if groups is None:
            return alone.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        own = leading.select(F.col("node").alias("u"), "token")
        members = leading.select("grp", "token", F.col("node").alias("v"), F.col("n").alias("size"), F.col("reach").alias("far"), F.col("end").alias("until"))
        # of the tokens that a class has in common with a group, a member must have ``least``: it has one of all but least - 1, the rarest ones
        both = Window.partitionBy("u", "grp")
        some = (opened.where("one < two").drop("one", "two").join(own, "u").join(matrix.select("grp", "token", "rows", "lo", "hi", "far"), ["grp", "token"])
                .where("3 * lo <= 4 * n and 4 * hi >= 3 * n").where(_in_reach("lo", "far")).drop("lo", "hi", "far")
                .withColumn("place", F.row_number().over(both.orderBy("rows", "token"))).withColumn("all", F.count("*").over(both)).where("place <= all - least + 1"))
        met = some.join(members, ["grp", "token"]).where("4 * least(n, size) >= 3 * greatest(n, size)").where(_in_reach("size", "far")).select("u", "v", "n", "size", "end", "until").distinct()
        met = stored(met, "met")
        sets = own.join(met.select("u").union(met.select("v")).distinct(), "u", "left_semi").groupBy("u").agg(F.collect_list("token").alias("tokens"))
        met = (met.join(sets, "u").join(sets.toDF("v", "others"), "v")
               .select("u", "v", "n", "size", F.size(F.array_intersect("tokens", "others")).alias("met"), (F.col("end") <= F.col("until")).alias("first")))
        left = F.when(F.col("first"), _kept(F.col("n"))).otherwise(_kept(F.col("size"))) - 1
        several = met.where(F.col("met") + left >= F.ceil((F.col("n") + F.col("size")) * 3 / 7)).select("u", "v")
        return alone.union(several).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    def links(self) -> DataFrame:
        """Links (u, v) between class nodes that connect every component."""
        found = self.verified(self.leader_pairs(0, None))
        for turn in range(1, TURNS):
            found = found.union(self.verified(self.leader_pairs(turn, components(found))))
        leading, groups = self.leading(), components(found)
        found = found.union(self.verified(self.centre_pairs(leading, groups)))
        return found.union(self.verified(self.group_pairs(leading, components(found))))

    def all_links(self) -> DataFrame:
        """Every link (u, v) between classes, by fingerprint, once each."""
        found, sig = self.verified(self.group_pairs(self.leading(), None)), self.classes.select("node", "sig")
        return (found.join(sig.toDF("u", "a"), "u").join(sig.toDF("v", "b"), "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())

    def pairs(self) -> DataFrame:
        """Every pair (u, v), u < v, of documents that link."""
        own = self.profiles.where("n > 0 and doc_id is not null").select("sig", "doc_id").distinct()
        links = self.all_links()
        links = links.union(self.classes.select("sig", "sig"))
        both = links.join(own.toDF("u", "a"), "u").join(own.toDF("v", "b"), "v").where("a <> b")
        return both.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()

    def membership(self) -> DataFrame:
        """(doc_id, n_shingles, component_id), a row per row of the documents."""
        links = self.links()
        if not self.repeated_ids:
            nodes = self.classes.join(components(links), "node", "left").select("sig", F.coalesce("component", "rep").alias("component_id"))
            rows = self.profiles.join(nodes, "sig", "left")
            return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
        # the texts of an id belong together
        own = self.profiles.where("n > 0 and doc_id is not null").select("doc_id", "sig")
        same = own.join(own.groupBy("doc_id").agg(F.min("sig").alias("u")), "doc_id").where("u <> sig").select("u", F.col("sig").alias("v"))
        nodes = self.classes.join(components(links.union(same)), "node", "left").select("sig", "rep", F.coalesce("component", "node").alias("component"))
        low = nodes.groupBy("component").agg(F.min("rep").alias("component_id"))
        nodes = nodes.join(low, "component").select("sig", "component_id")
        ids = own.join(nodes, "sig").groupBy("doc_id").agg(F.min("component_id").alias("of_id"))
        return (self.profiles.join(nodes, "sig", "left").join(ids, "doc_id", "left")
                .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("of_id", "component_id", "doc_id").alias("component_id")))

    def one_of_each(self, docs: DataFrame) -> DataFrame:
        """The rows of ``docs`` without those that link to a document of a smaller id, directly or by others.

        Rows without an id stay. Rows that repeat an id and its text count once, unless the text has no words.
        """
        gone, again = free(docs, "_gone"), free(docs, "_again")
        drop = self.membership().where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
        kept = docs.join(drop, docs["doc_id"] == drop[gone], "left_anti")
        if not self.repeated_ids:
            return kept
        blank = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)) == 0
        alone = F.when(blank | F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(-1)
        return kept.withColumn(again, alone).dropDuplicates(["doc_id", "text", again]).drop(again)


def _with_sign(words: int, batches):
    known = WordHashes()
    for b in batches:
        signs = [_sign(u) if len(u := shingles(x, known, words)) else None for x in texts(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(signs, pa.int64())], ["doc_id", "text", "sig"])
