"""The cuckoo index against grouping by force, with insertions, deletions and crowded filters."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from fungo.llm.cuckoo import CuckooFilter, CuckooIndex


def by_force(rows):
    """Decisions over (doc_id, text) rows; only rows equal in all respects can be swapped."""
    groups = defaultdict(list)
    for at, (doc, text) in enumerate(rows):
        t = text or ""
        groups[t.translate({ord(c): None for c in " \t\n\r\x0b\x0c"})].append((-len(t), doc is None, doc or 0, at))
    out = []
    for norm, own in groups.items():
        best = min(own)
        out += [(None if none else doc, None if best[1] else best[2], len(own), at == best[3], hashlib.sha256(norm.encode()).hexdigest()) for _, none, doc, at in own]
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def decided(index):
    return Counter(tuple(r) for r in index.decisions().collect())


def test_filter_inserts_deletes_and_grows():
    rng = random.Random(3)
    live, own = set(), CuckooFilter(64)
    for _ in range(4000):
        if live and rng.random() < 0.3:
            d = rng.choice(sorted(live))
            live.remove(d)
            assert own.delete(d)
        else:
            d = rng.getrandbits(64) - (1 << 63)
            live.add(d)
            if not own.insert(d):
                own = CuckooFilter.of(live, 2 * own.buckets)
        if len(live) % 97 == 0:
            assert all(x in own for x in live)
    assert own.buckets > 64 and all(x in own for x in live)
    assert sum(rng.getrandbits(63) in own for _ in range(20000)) < 20
    for d in list(live):
        assert own.delete(d)
    assert not any(own.slots)
    again = CuckooFilter(own.buckets, own.slots.tobytes())
    assert again.slots == own.slots and not again.delete(5)


@pytest.mark.parametrize("bits,hold,shard", [(64, 32 << 20, 16 << 20), (3, 300, 200), (0, 5000, 64)])
def test_batches_of_insertions_and_deletions(spark, bits, hold, shard):
    rng = random.Random(bits)
    text = lambda: None if rng.random() < 0.1 else " " * rng.randint(0, 2) + rng.choice("abcdefghijklmnopqrstuvw") + rng.choice(["", "\n", "\t x", "é"])
    index, rows = CuckooIndex(spark, bits, hold, shard, live=10), []
    for step in range(3):
        new = [(None if rng.random() < 0.05 else 100 * step + i, text()) for i in range(80)]
        index.insert(frame(spark, new).repartition(3))
        rows += new
        assert decided(index) == by_force(rows)
        gone = rng.sample(range(100 * step + 80), 40 + 30 * step) + [None, 10 ** 9]
        index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        rows = [r for r in rows if r[0] is None or r[0] not in gone]
        assert decided(index) == by_force(rows)
        # filters hold the live digests and nothing else
        marks = sum(sum(1 for x in CuckooFilter(r.buckets, bytes(r.slots)).slots if x) for r in index.filters.collect())
        assert marks == index.classes.select("digest").distinct().count()
    assert index.shards > 1 or shard > 1000


def test_index_emptied_and_used_again(spark):
    index = CuckooIndex(spark).insert(frame(spark, [(1, "a b"), (2, "ab")])).delete(spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert index.decisions().count() == 0
    assert decided(index.insert(frame(spark, [(3, "a  b"), (4, "c")]))) == by_force([(3, "a  b"), (4, "c")])


def test_awkward_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = CuckooIndex(spark).insert(odd_docs)
    assert got.decisions().columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert decided(got) == by_force(rows)
    empty = next(r for r in got.decisions().collect() if r.doc_id == 4)
    assert (empty.keep_id, empty.group_size, empty.kept) == (4, 3, True)
    assert CuckooIndex(spark).insert(no_docs).decisions().count() == 0
    assert CuckooIndex(spark).insert(no_docs).delete(no_docs).insert(odd_docs).decisions().count() == len(rows)
