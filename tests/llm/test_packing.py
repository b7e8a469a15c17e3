"""Corpus-wide weights and shards by content."""

import random

import numpy as np
import pytest

import fungo.llm.queries as Q
from fungo.llm import packing
from test_text_queries import whole


def topics(seed=5, n=40, each=12):
    """Documents of ``n`` topics, each with words of its own; ids tell nothing."""
    r, rows = random.Random(seed), []
    common = ["the", "of", "and", "to", "in"]
    words = [[w + x for w in r.sample(["stone", "river", "market", "engine", "planet", "garden", "copper", "letter", "window", "silver"], 4) for x in r.sample(["ism", "wick", "ford", "dale", "berg"], 3)] for _ in range(n)]
    ids = list(range(n * each))
    r.shuffle(ids)
    for i, d in enumerate(ids):
        rows.append((d, i % n, " ".join(r.choice(words[i % n] if r.random() < 0.7 else common) for _ in range(120))))
    return rows


def test_shards_hold_like_documents(spark):
    rows = topics()
    path, total = Q.tokenizer_path(), sum(len(t) for _, _, t in rows)
    docs = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")
    pieces = packing.packed(docs, path, 512, total // 8).collect()
    whole(pieces, [(d, t) for d, _, t in rows], path, 512)
    topic, shard = {d: k for d, k, _ in rows}, {p.doc_id: p.sequence_id >> 32 for p in pieces}
    assert len(set(shard.values())) >= 8
    same = [shard[a] == shard[b] for a in topic for b in topic if a < b and topic[a] == topic[b]]
    assert np.mean(same) > 0.4  # one in eight by chance


def test_weights_are_of_all_documents():
    corpus = packing.Corpus(np.array([3, 4]), np.array([1, 900]), 1000, 4000)
    index = packing.Index([np.array([3, 4], "<u2"), np.array([4, 4], "<u2"), np.array([3], "<u2")], corpus)
    # 4 is the more frequent token of the corpus, though both occur in two documents of the shard
    assert list(index.neighbours(0, np.array([False, True, True]))) == [2, 1]


def test_copies_of_one_row_are_no_single_shard(spark):
    rows = [(1, "same words in every row " * 20)] * 60 + [(None, "other words " * (20 + i)) for i in range(60)]
    path = Q.tokenizer_path()
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), path, 64, 4000).collect()
    whole(pieces, rows, path, 64)
    per = {}
    for p in pieces:
        per[p.sequence_id >> 32] = per.get(p.sequence_id >> 32, 0) + p.length
    assert max(per.values()) < sum(per.values()) / 3


def test_small_groups_share_a_shard():
    assert packing.shard_table({0: 3, 1: 4, 2: 25, 3: 5, 4: 6}, 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 5, 1)]


@pytest.mark.parametrize("letters", ["ab. ,\x1c\x1d\x1e\x1f#", "aZ9.,; \n\t\r\x0b\xa0\u2028\u3000É", "the., \x85\x00\x07'-\"İß"])
def test_ids_are_those_of_the_tokenizer(letters):
    """Random short texts, control characters and odd blanks among them."""
    encoder, r = packing.Encoder(Q.tokenizer_path()), random.Random(letters)
    items = ["#\x1f. ", "a\x1c, b", ""] + ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(8000)]
    got = encoder([x.encode() for x in items])
    for x, ids in zip(items, got):
        assert np.frombuffer(ids, encoder.kind).tolist() == [*encoder.tokenizer.encode(x, add_special_tokens=False).ids, packing.END], repr(x)


def test_remembered_words_stay_few(monkeypatch):
    """Also within one call, and not the long ones, which seldom come again."""
    monkeypatch.setattr(packing, "MEMO", 50)
    encoder = packing.Encoder(Q.tokenizer_path())
    items = [" ".join(f"{a}{b}x" for b in "abcdefghij") + " averylongwordindeed" for a in "klmnopqrst" * 3]
    got = encoder([x.encode() for x in items])
    assert len(encoder.known) <= 50 + 11 and "averylongwordindeed" not in encoder.known
    for x, ids in zip(items, got):
        assert np.frombuffer(ids, encoder.kind).tolist() == [*encoder.tokenizer.encode(x, add_special_tokens=False).ids, packing.END]


def test_the_last_round_is_not_dealt_again(spark, monkeypatch):
    """What the last round deals goes on with its ids, and is what dealing from the start gives."""
    monkeypatch.setattr(packing, "ROUNDS", 2)
    rows, kind = topics(n=8, each=30), np.dtype("<u2")
    encoder = packing.Encoder(Q.tokenizer_path())
    ids = encoder([t.encode() for _, _, t in rows])
    docs = [np.frombuffer(x, kind) for x in ids]
    token, df = np.unique(np.concatenate([np.unique(d) for d in docs]), return_counts=True)
    corpus = packing.Corpus(token, df, len(docs), sum(map(len, docs)))
    table = spark.createDataFrame([(r[0], bytearray(x), hash(x), len(d)) for r, x, d in zip(rows, ids, docs)], "doc_id long, ids binary, hash long, size long")
    rounds, places = packing.dealt(table, kind, corpus, 1200)
    assert len(rounds) == 2 and "ids" in places.columns
    again = table.mapInArrow(lambda b: packing._deal(kind, rounds, True, b), packing.DEALT)
    assert places.exceptAll(again).isEmpty() and again.exceptAll(places).isEmpty() and places.count() == len(rows)


def test_leaders_by_force():
    """Many documents at a time, and few scores at a time, as one by one."""
    r = np.random.default_rng(3)
    profiles = [(t := np.unique(r.integers(0, 60, 12)), r.random(len(t))) for _ in range(7)]
    docs = [r.integers(0, 80, r.integers(0, 30)).astype("<u2") for _ in range(50)]
    doc, token = packing._distinct(np.concatenate(docs), np.array([len(d) for d in docs]))
    want = [int(np.argmax([sum(w for t, w in zip(*p) if t in set(d.tolist())) for p in profiles])) for d in docs]
    for postings in (1, 40, 1 << 18):
        packing.POSTINGS, kept = postings, packing.POSTINGS
        try:
            assert packing.Leaders(profiles, 1).of(doc, token, len(docs)).tolist() == want
        finally:
            packing.POSTINGS = kept
