"""Running a stream into a table of batches, replayable after a failure.

Every micro-batch writes its own folder, named by the batch id and overwritten if the
batch is repeated, so a restarted query never writes a row twice. Checkpoints and
tables live in the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from fungo.operators import ordered


def file_stream(spark: SparkSession, folder: str, table: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table of a folder as a stream, whether it is one file or a folder of part files."""
    r = spark.readStream.schema(schema)
    # as a pattern, since a stream takes a plain path for a folder only
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).parquet(f"{folder}/{table}.parque[t]")


def drain(stream: DataFrame, path: str, mode: str = "append", prepare: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Process everything available, one folder per batch, and return the batches with their number."""

    def write(batch: DataFrame, number: int) -> None:
        rows = prepare(batch, number) if prepare else batch
        rows.write.mode("overwrite").parquet(f"{path}/rows/_batch={number}")

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows")


def latest_per_key(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest version of each key of an update-mode stream."""
    return ordered.latest(batches, keys, ["_batch"]).drop("_batch").select(*[c for c in batches.columns if c != "_batch"])


def each_batch(stream: DataFrame, path: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Process everything available with a handler per micro-batch."""
    q = stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(handle).start()
    q.awaitTermination()
