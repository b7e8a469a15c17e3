"""Tables that several pipelines of a run share: written once, bucketed by the key they are joined on.

A bucketed table keeps its partitioning, so joins and groupings on the key read it
without an exchange, and a lost executor costs the task that it ran, not the pipelines
behind the table. The files lie in the shared folder of the session; the session's
catalog only knows them by a name that no other run uses. The number of buckets is the
session's number of shuffle partitions unless given, which is what makes a table and a
shuffled frame meet without moving the table.

Bucket by a key with many values (a game, a pitcher and a day). A team is no such key.

Disk: what the exchanges of a table's job wrote goes with the job, not whenever the driver
collects its garbage, and ``drop`` removes a table whose readers are written themselves.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from fungo.session import checkpoint_root

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Jobs begun in here remove their shuffle files as they end; the session's own setting comes back after."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Shelf:
    def __init__(self, spark: SparkSession, buckets: int | None = None):
        self.spark = spark
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.id = uuid.uuid4().hex
        self.root = f"{checkpoint_root(spark)}/shelf-{self.id}"
        self.names: list[str] = []

    def put(self, name: str, df: DataFrame, keys: Sequence[str], dealt: bool = False) -> DataFrame:
        """``df`` as a table bucketed and sorted by ``keys``. ``dealt`` says that its rows already lie by them."""
        rows = df if dealt else df.repartition(self.buckets, *keys)
        table = f"shelf_{self.id}_{name}"
        with without_leftovers(self.spark):
            (rows.write.format("parquet").options(path=f"{self.root}/{name}", compression="zstd")
             .bucketBy(self.buckets, *keys).sortBy(*keys).saveAsTable(table))
        self.names.append(table)
        return self.spark.table(table)

    def put_all(self, frames: Mapping[str, DataFrame], keys: Sequence[str], at_once: int = 4, dealt: bool = True) -> list[DataFrame]:
        """Several frames by the same keys, ``at_once`` of them as concurrent jobs."""
        with without_leftovers(self.spark), ThreadPoolExecutor(at_once) as pool:
            return list(pool.map(lambda item: self.put(item[0], item[1], keys, dealt), frames.items()))

    def drop(self, *names: str) -> None:
        """Removes tables with their files. Only for tables that no frame still to be run reads."""
        for name in names:
            table = f"shelf_{self.id}_{name}"
            self.spark.sql(f"drop table if exists {table}")
            self.names.remove(table)
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)

    def forget(self) -> None:
        """Takes the tables out of the session's catalog; their files stay for plans that still read them."""
        for table in self.names:
            self.spark.sql(f"drop table if exists {table}")
        self.names.clear()
