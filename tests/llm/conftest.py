"""Frames of the awkward cases that every text operator must take."""

import pytest

LONG = "word " * 5000

#: nulls, empty and very long texts, repeated rows, ties
DOCS = [(1, "One two three four five six seven.", "a"), (2, None, None), (3, "", "b"), (4, " \t\n ", "a"), (5, LONG, "b"), (6, "One two three four five six seven.", "a"),
        (7, "ONE two three four five six seven.", None), (7, "ONE two three four five six seven.", None), (None, "no id but words", "b"), (8, "Été über naïve 日本語 words", "c"),
        (9, "x", "c")]


@pytest.fixture()
def odd_docs(spark):
    """Documents with awkward values and columns whose names clash with results and working columns."""
    rows = [(*r, 1.5, "score", 7, 0, "t") for r in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, _score string, _size long, n_words int, _row string")


@pytest.fixture()
def no_docs(odd_docs):
    return odd_docs.limit(0)
