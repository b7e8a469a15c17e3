"""Links and components against comparing every pair."""

import random

import pytest

from fungo.llm import ngram_join
from fungo.llm.components import components
from fungo.llm.ngram_join import NgramJoin


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(d, low.get(root(i), d))
    return sorted(((d, len(sets[i]), low.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in NgramJoin(docs).membership().collect()), key=str)


def corpus(seed):
    """Copies, chains of near copies, a passage that many share, and texts on the edge of the threshold."""
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice("klmnop") + str(r.randrange(60))
    passage, rows = [word() for _ in range(40)], []
    for _ in range(30):
        base = [word() for _ in range(r.choice((3, 6, 20, 60)))]
        if r.random() < 0.5:
            base = base[:10] + passage + base[10:]
        rows.append(" ".join(base))
        for _ in range(r.choice((0, 0, 1, 4))):
            base = list(base)
            for _ in range(r.choice((0, 1, 1, 2))):
                base[r.randrange(len(base))] = word()
            rows.append(" ".join(base).upper() if r.random() < 0.3 else " ".join(base))
    return [(i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,frequent", [(1, 200_000), (2, 0)])
def test_random_corpora(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "OFTEN", 2)
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_edge_cases(spark, odd_docs, no_docs):
    got = sorted((tuple(r) for r in NgramJoin(odd_docs).membership().collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    kept = NgramJoin(odd_docs).one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 8, 9, None], key=str)
    assert NgramJoin(no_docs).membership().count() == 0
    assert NgramJoin(no_docs).one_of_each(no_docs).count() == 0


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (200, 200), (300, 250)] + [(500, i) for i in range(501, 560)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(pairs, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 103: 100, 105: 100, 250: 250, 300: 250, **{i: 500 for i in range(500, 560)}}
