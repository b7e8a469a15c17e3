"""From documents to packed training sequences: five stages, each over all that the one before kept.

Stages 1 and 2 train on the labelled documents they are given, by the operators' own
split, and drop what they reject; stage 3 keeps the document of smallest id of each group
of near duplicates; stage 4 emits documents as often as the mix takes them; stage 5 cuts
and packs their tokens. Every stage's result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fungo.llm import mixing, packing, quality, toxicity
from fungo.llm.common import free, stored, table
from fungo.llm.ngram_join import NgramJoin
from fungo.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    name = free(docs, "_score")
    return toxicity.score(docs, model, name).where(F.col(name) < 0.5).drop(name)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality of at least 0.3; all, where no labelled document of each class is left to learn from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.edges:
        return docs
    name = free(docs, "_score")
    return quality.score(docs, model, name).where(F.col(name) >= 0.3).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return NgramJoin(docs).one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifiers are trained and the sequences are made of token ids, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
