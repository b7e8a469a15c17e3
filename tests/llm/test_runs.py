"""Periodic runs against a search by force, and on awkward rows."""

import random

import numpy as np
import pytest

from fungo.llm import runs


def by_force(w, min_length, min_exponent):
    """(start, length, period) of every run, by comparing words one period apart."""
    found = {}
    for p in range(1, len(w) // min_exponent + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(min_length, min_exponent * p):
                found.setdefault((s, i + p - s), p)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def some_words(rng):
    n, k = rng.randint(0, 70), rng.randint(1, 3)
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.5:
        a, p = rng.randrange(n), rng.randint(1, 9)
        w = [w[i] if i < a else w[min(n - 1, a + (i - a) % p)] for i in range(n)]
    return w


@pytest.mark.parametrize("min_length,min_exponent", [(24, 3), (6, 3), (1, 2), (10, 5)])
def test_finds_every_run(monkeypatch, min_length, min_exponent):
    monkeypatch.setattr(runs, "SLICE", 16)
    rng = random.Random(min_length)
    for _ in range(150):
        docs = [some_words(rng) for _ in range(rng.randint(1, 5))]
        got = runs.find(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]), min_length, min_exponent)
        assert [tuple(r) for r in got.tolist()] == [(i, *r) for i, d in enumerate(docs) for r in by_force(d, min_length, min_exponent)]


def test_collapses_runs(spark):
    rows = [(1, "x " + "a b c " * 9 + "a b y"), (2, "a\tb\n" * 11 + "a"), (3, "z\xa0 " * 30), (4, "b " * 24 + "a " * 24), (5, "né " * 23)]
    got = {r.doc_id: r for r in runs.annotated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].runs, got[1].collapsed, got[1].n_words) == ([(1, 29, 3)], "x a b c y", 31)
    assert (got[2].runs, got[2].collapsed) == ([], " ".join("ab" * 11 + "a"))
    assert (got[3].runs, got[3].collapsed) == ([(0, 30, 1)], "z\xa0")
    assert (got[4].runs, got[4].collapsed) == ([(0, 24, 1), (24, 24, 1)], "b a")
    assert got[5].runs == [] and got[5].n_words == 23
    short = runs.annotated(spark.createDataFrame(rows, "doc_id long, text string"), min_length=22, min_exponent=2).where("doc_id = 2").first()
    assert short.runs == [(0, 23, 2)] and short.collapsed == "a b"


def test_awkward_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("runs", odd_docs.n_words).withColumn("Collapsed", odd_docs.score)
    out = runs.annotated(clash)
    assert out.columns == [*clash.columns, "n_words_", "runs_", "collapsed_"]
    rows = out.collect()
    assert sorted(map(str, (r[:10] for r in rows))) == sorted(map(str, (tuple(r) for r in clash.collect())))
    by = {r.doc_id: r for r in rows}
    assert by[5].runs_ == [(0, 5000, 1)] and by[5].collapsed_ == "word"
    assert all((by[i].n_words_, by[i].runs_, by[i].collapsed_) == (0, [], "") for i in (2, 3, 4))
    assert by[None].collapsed_ == "no id but words" and by[8].collapsed_ == "Été über naïve 日本語 words"
    assert runs.annotated(no_docs).count() == 0
    with pytest.raises(ValueError):
        runs.annotated(odd_docs, min_exponent=1)
