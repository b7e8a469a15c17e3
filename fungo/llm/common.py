"""Helpers that the text operators share.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``. In Python that is what
``bytes.split`` cuts at, and ``bytes.lower`` lowers A-Z alone, so tasks work on UTF-8.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from fungo.session import checkpoint_root

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
#: Bytes of text that a task turns into Python objects at a time.
CHUNK = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder, by these options, and read again; cuts the lineage."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/text-{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def is_held_out(doc_id: Column, of: int, value: int) -> Column:
    return F.coalesce(remainder(doc_id, of) == value, F.lit(False))


def texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """Numbers of words, remembered; ``hashes`` has their 64-bit hashes."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit, self.hashes = limit, np.zeros(limit, np.uint64)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.hashes[i] = xxhash.xxh3_64_intdigest(word)
        return i

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self) + len(words) > self.limit:
            self.clear()
            if len(words) > self.limit:
                self.limit, self.hashes = len(words), np.zeros(len(words), np.uint64)
        return self.hashes[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]


def chunks(items: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Index ranges of ``items`` of about ``limit`` bytes; a longer item stands alone."""
    start = size = 0
    for i, x in enumerate(items):
        if i > start and size + len(x) > limit:
            yield start, i
            start, size = i, 0
        size += len(x)
    if start < len(items):
        yield start, len(items)


def with_column_from_text(df: DataFrame, text: str, out: str, ddl: str,
                          make: Callable[[], Callable[[list[bytes]], list]]) -> DataFrame:
    """``df`` plus column ``out``, computed in Arrow batches from the whole text.

    ``make`` runs once per task and returns the function of a list of texts.
    """
    kind = StructType.fromDDL(f"x {ddl}")[0].dataType
    at, schema = df.columns.index(text), StructType([*df.schema.fields, StructField(out, kind)])
    arrow = {"double": pa.float64(), "int": pa.int32(), "bigint": pa.int64()}.get(ddl)

    def run(batches):
        fn = make()
        for b in batches:
            items, found = texts(b.column(at)), []
            for i, j in chunks(items):
                found.extend(fn(items[i:j]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, arrow)], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, folds: int = 5) -> DataFrame:
    """Columns text and y of at most ``per_class`` labelled training rows of each class.

    Rows of fold 0 never train. The rows are those with the smallest hash of the id, so
    reruns agree; their ids, at most twice ``per_class``, are broadcast. An id labelled
    more than once takes its largest label; labels other than 0 and 1 are ignored.
    """
    known = (labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), folds) != 0))
             .groupBy("doc_id").agg(F.max(target).cast("int").alias("y")))
    known = known.join(docs.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = stored(picked[0].union(picked[1]), f"{target}-ids").select(F.col("doc_id").alias("_id"), "y")
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("text", "y")
