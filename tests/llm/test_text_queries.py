"""Registered text queries against their SQL, and the operators on awkward rows."""

import zlib
from collections import Counter

import numpy as np
import pytest

import fungo.llm.queries as Q
from compare import connect, table
from fungo.llm import chat, katz, licenses, mixing, packing, quality, quality_rules, topk, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_matches_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    cur = con.execute(Q.ORACLE[name])
    got, want = table([tuple(r) for r in df.collect()], df.columns), table(cur.fetchall(), [d[0] for d in cur.description])
    assert got == want


@pytest.mark.parametrize("module,target,threshold", [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_classifiers(spark, odd_docs, no_docs, module, target, threshold):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = module.fit(docs, labels)
    rows = module.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").select("doc_id", "score", target).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = sum((r.score >= threshold) == r[target] for r in held) / len(held)
    assert right >= (0.97 if target == "toxic" else 0.99)
    odd = module.score(odd_docs, model, "result")
    assert odd.columns == [*odd_docs.columns, "result"] and all(0 <= r.result <= 1 for r in odd.collect()) and odd.count() == odd_docs.count()
    assert module.score(no_docs, model, "result").count() == 0
    none = module.fit(docs, labels.limit(0))
    assert {r.result for r in module.score(odd_docs, none, "result").collect()} == {0.0}
    if target == "toxic":  # gaps and inserted characters keep an insult close
        near = spark.createDataFrame([(1, "was the l.o.s.e.r and an id-i0t of st"), (2, "was the of and an ing of st"), (3, "the w o r t h l e s s paathetic m0ron by")], "doc_id long, text string")
        got = {r.doc_id: r.score for r in module.score(near, model).collect()}
        assert got[1] >= 0.5 > got[2] and got[3] >= 0.5


def test_mixing(spark, odd_docs, no_docs):
    mixed = lambda docs: mixing.mixed(mixing.sized(docs, ["doc_id", "source"])).select("_doc.*", "size", "source_size", "target", "copies").collect()
    rows = mixed(odd_docs)
    assert len(rows) == odd_docs.count() and all(0 <= r.copies <= 3 and r.target <= 3 * r.source_size + 1e-9 for r in rows)
    assert sum(r.target for r in {r.source: r for r in rows}.values()) == pytest.approx(sum(r.size for r in rows))
    out = mixing.emit(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r.copies for r in rows)
    assert mixing.emit(no_docs).count() == 0
    assert Counter((r.doc_id, r.copies) for r in rows) == Counter((r.doc_id, r.copies) for r in mixed(odd_docs.repartition(7)))


def test_mixing_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * i % 97), "abc"[i % 3] if i % 10 else "d") for i in range(3000)], "doc_id long, text string, source string")
    got = {}
    for r in mixing.mixed(mixing.sized(docs)).select("_doc.source", "size", "target", "copies").collect():
        t = got.setdefault(r.source, [0, r.target])
        t[0] += r.size * r.copies
    assert all(abs(a - b) <= 0.02 * b + 300 for a, b in got.values())


def test_rules(spark, odd_docs, no_docs):
    got = quality_rules.judged(odd_docs.select("doc_id", "text")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.quality <= 1 for r in got)
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_words, long.n_repeat_words, long.kept) == (5000, 5000, False)
    assert quality_rules.judged(no_docs.select("doc_id", "text")).count() == 0
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judged(docs.select("doc_id", "text")).drop("quality").join(labels, "doc_id").where("not base_failed").select("kept", "quality").collect()
    assert all(r.kept for r in rows if r.quality == 1) and sum(not r.kept for r in rows) >= 20


def test_rules_beside_clashing_columns(odd_docs):
    clash = odd_docs.withColumns({"n_symbols": odd_docs.score, "_words": odd_docs.score, "quality": odd_docs._score, "_h": odd_docs.score})
    plain = {(r.doc_id, r.n_words, r.n_symbols, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.judged(odd_docs.select("doc_id", "text")).collect()}
    got = quality_rules.judged(clash)
    assert got.columns[:len(clash.columns) - 1] == [c for c in clash.columns if c != "text"]
    rows = got.collect()
    assert {(r.doc_id, r.n_words_, r.n_symbols_, r.n_repeat_words, r.base_failed, r.kept) for r in rows} == plain
    assert all(r.n_words == 0 and r.n_symbols == 1.5 and r._words == 1.5 and 0 <= r.quality_ <= 1 for r in rows) and len(rows) == clash.count()
    assert quality_rules.judged(odd_docs.select("text")).count() == odd_docs.count()


def test_licenses(spark, odd_docs, no_docs):
    docs = spark.createDataFrame([(1, "Released under\nthe MIT-License. Apache License, mit license"), (2, "This work, licensed now, under the GNU free general license of the work is ours"),
                                  (3, None), (4, "MİT license"), (5, "x " * 40 + "licensed under the apache license version two")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scanned(docs).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels, got[1].score) == (3, 3, 7, "apache,mit", 1.0)
    assert "mit-release" in got[1].labels.split(",")
    assert "gpl-family" in got[2].labels and got[2].n_base == 0 and 0.8 <= got[2].score < 1
    assert (got[3].n_words, got[3].labels, got[3].score, got[3].first_word) == (0, "", 0.0, None)
    assert got[4].n_base == 0 and got[5].base_labels == "apache"
    assert licenses.scanned(odd_docs).count() == odd_docs.count() and licenses.scanned(no_docs).count() == 0


def test_chat(spark):
    rows = [(1, 0, "ann", "hi <|end|>"), (1, 1, "bob", None), (1, 1, "bob", None), (1, None, None, "first"), (None, 0, "ann", ""), *((2, i, "abc"[i % 3], str(i)) for i in range(200))]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.speaker, r.block): r for r in chat.rotated(conv).collect()}
    assert len(got) == 3 + 1 + 3 * 4
    r = got[1, "ann", 0]
    assert r.rendered == "<|user:unknown|>\nfirst<|end|>\n<|assistant|>\nhi < |end| ><|end|>\n" + 2 * "<|user:bob|>\n<|end|>\n"
    assert [r.rendered[s["from"]:s["to"]] for s in r.spans] == ["hi < |end| ><|end|>\n"]
    assert sum(got[2, "a", b].n_turns for b in range(4)) == 200 and sum(got[2, "a", b].n_trained for b in range(4)) == 67
    assert chat.rotated(conv.limit(0)).count() == 0


@pytest.mark.parametrize("k,scale", [(3, 64), (20, 1000)])
def test_topk(spark, monkeypatch, k, scale):
    monkeypatch.setattr(topk, "SHARD", 40)
    monkeypatch.setattr(topk, "SEED", 30)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 8) * (np.arange(8) < 3 + i % 6)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 8) for i in range(30)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, []), (None, [1.0] * 8), (404, [0.25] * 3), (3, rows[3][1])]
    got = sorted(tuple(r) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id % 5 = 0", k, scale).collect())
    ints = {i: [int(np.floor(scale * float(np.float32(x)))) for x in v] for i, v in rows if i is not None and v and i not in (401, 402)}
    want = []
    for q in ints:
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:k]
            want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert got == sorted(want)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), "true", k).count() == 0


def whole(pieces, texts, path, length):
    """Every id of every document stands in one piece; windows have no gaps and are full or a power of two."""
    encoder = packing.Encoder(path)
    want = Counter((d, np.frombuffer(encoder([(t or "").encode()])[0], encoder.kind).astype("<u4").tobytes()) for d, t in texts)
    by, windows = {}, {}
    for p in pieces:
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at == length or at < length and at & at - 1 == 0
    assert sum(p.length for p in pieces) == sum(len(b) // 4 * n for (_, b), n in want.items())
    for (d, b), n in want.items():
        ids = np.frombuffer(b, "<u4")
        own = by[d, len(ids)]
        assert all(zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32 for p in own)
        assert Counter(i for p in own for i in range(p.start, p.start + p.length)) == Counter({i: n for i in range(len(ids))})


def test_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = Q.tokenizer_path()
    pieces = packing.packed(odd_docs, path, 256).collect()
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    whole(pieces, rows, path, 256)
    assert packing.packed(no_docs, path).count() == 0
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    tokenizer, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    for _, t in [*rows, *real, (0, "a<|endoftext|>b 's x y\r\nİ ΑΣ Σ é 12,5!")]:
        t = t or ""
        assert np.frombuffer(encoder([t.encode()])[0], encoder.kind).tolist() == [*tokenizer.encode(t, add_special_tokens=False).ids, 2]


def test_katz_on_awkward_rows(spark, odd_docs):
    got = katz.scores(odd_docs.select("doc_id", "text"), "doc_id <> 9").collect()
    assert len(got) == odd_docs.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
