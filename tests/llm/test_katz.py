"""The language model against counting and backing off word by word."""

import math
import zlib
from collections import Counter

import pytest

from fungo.llm import katz

ROWS = [(1, "the cat sat on the mat the cat"), (2, "The cat ate the mat\tand the dog"), (3, None), (4, ""), (5, "zebra zebra unknown cat"), (6, "the dog sat"),
        (6, "the dog sat"), (7, "the cat sat on the mat the cat"), (8, "a b " * 30), (9, "the Été CAT sat"), (None, "no id here")]
RULE = "crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"


def brute(rows, held):
    token = [(i, [*(t or "").encode().lower().split(), b"\0"]) for i, t in rows]
    train = [w for (i, w) in token if not held(i)]
    one = Counter(x for w in train for x in w)
    two = Counter(p for w in train for p in zip([None, *w], w))
    hist = Counter({None: len(train)}) + Counter(x for w in train for x in w[:-1])
    n, k = sum(one.values()), katz.K
    of = lambda c: katz.discounts([0, *(sum(v == r for v in c.values()) for r in range(1, k + 2))])
    d1, d2 = of(one), of(two)
    keep = lambda c, d: c - katz.SLIP if c > k else c * d[c - 1]
    unknown = 1 - sum(keep(c, d1) for c in one.values()) / n
    p1 = lambda w: keep(one[w], d1) / n if w in one else unknown
    after = {}
    for (h, w), c in two.items():
        after.setdefault(h, {})[w] = c

    back = {h: (1 - sum(keep(c, d2) for c in ws.values()) / hist[h]) / (1 - sum(p1(x) for x in ws)) for h, ws in after.items()}

    def p2(h, w):
        if h not in after:
            return p1(w)
        return keep(after[h][w], d2) / hist[h] if w in after[h] else back[h] * p1(w)

    for h in [*list(after)[:20], b"nobody"]:  # what follows any history adds up to one
        assert math.isclose(sum(p2(h, w) for w in one) + p2(h, b"\1"), 1, rel_tol=1e-9)
    return [(i, len(w), sum(x in one for x in w), n, sum(math.log10((one[x] + 1) / (n + len(one) + 1)) for x in w), sum(math.log10(p2(h, x)) for h, x in zip([None, *w], w)))
            for i, w in token]


def same(spark, rows, held, rule):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(([r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score] for r in katz.scores(docs, rule).collect()), key=lambda r: (str(r[0]), r[5]))
    want = sorted(brute(rows, held), key=lambda r: (str(r[0]), r[5]))
    assert [r[:4] for r in got] == [list(r[:4]) for r in want]
    for g, w in zip(got, want):
        assert g[4:] == pytest.approx(w[4:], rel=1e-9)


@pytest.mark.parametrize("heavy,split", [(1 << 18, 1 << 14), (3, 1), (0, 0)])
def test_matches_brute_force(spark, monkeypatch, heavy, split):
    monkeypatch.setattr(katz, "HEAVY", heavy)
    monkeypatch.setattr(katz, "SPLIT", split)
    same(spark, ROWS, lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1, RULE)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.scores(docs, "false").first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)
    assert katz.scores(docs.limit(0), "true").count() == 0


def test_given_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same(spark, rows, lambda i: zlib.crc32(str(i).encode()) % 7 == 2, "crc32(cast(cast(doc_id as string) as binary)) % 7 <> 2")
