"""The pipeline, stage by stage, on the smallest tables that have labels enough."""

import pytest

import corpus_pipeline as P
import fungo.llm.queries as Q
from fungo.llm import quality, toxicity
from fungo.llm.ngram_join import NgramJoin
from test_ngram_join import brute
from test_text_queries import whole

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returned, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in P.STAGES:
        out.append(P.stored(stage(spark, out[-1], SF), name))
    return out


def test_columns(kept):
    assert [len(P.STAGES)] == [5] and all(d.columns == kept[0].columns for d in kept[1:-1])


def test_classifier_stages_drop_what_they_reject(spark, kept):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for i, (module, keep) in enumerate(((toxicity, "result < 0.5"), (quality, "result >= 0.3"))):
        want = module.score(kept[i], module.fit(kept[i], labels), "result").where(keep).select(*kept[0].columns)
        assert want.exceptAll(kept[i + 1]).isEmpty() and kept[i + 1].exceptAll(want).isEmpty()
        assert 0.5 * kept[i].count() < kept[i + 1].count() < kept[i].count()


def test_one_of_each_group_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[2].collect()]
    want = sorted(d for d, _, c in brute(rows) if d == c)
    assert sorted(r.doc_id for r in kept[3].collect()) == want
    assert NgramJoin(kept[3]).membership().where("doc_id <> component_id").isEmpty()


def test_mix_and_pieces(kept):
    before, after = ({}, {})
    for into, df in ((before, kept[3]), (after, kept[4])):
        for r in df.collect():
            into[r.doc_id] = into.get(r.doc_id, 0) + 1
    assert set(after) <= set(before) and max(after.values()) <= 3
    whole(kept[5].collect(), [(r.doc_id, r.text) for r in kept[4].collect()], Q.tokenizer_path(), 4096)


def test_awkward_rows_and_no_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in P.STAGES:
            got = stage(spark, docs, SF)
            if name != "packing":
                assert got.columns == docs.columns
            got.count()
