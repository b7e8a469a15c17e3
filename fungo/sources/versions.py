"""A table of Parquet partitions that changes by copy-on-write and a version pointer.

``data/_version=<n>/<column>=<value>`` holds what version n wrote; ``versions/_version=<n>`` says for
every partition which version holds it. A change reads and writes only the partitions
that its rows fall in (or leave), then writes the new list. That list, complete with its
success mark, is the pointer: until it is there, readers see the version before, so a
failed or repeated write changes nothing, and two writers of one version cannot both win.

The list has a row per partition and passes through the driver; rows of the table do
not. Where a table format with ``MERGE`` is at hand, ``DataFrame.mergeInto`` does this.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from fungo.operators import ordered

PLACES = "place string, v long, kind string"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, partition: str):
        self.spark, self.path, self.partition = spark, path, partition

    # --- versions

    def _glob(self, pattern: str) -> list:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p)
        return [f.getPath() for f in found] if found else []

    def version(self) -> int:
        """The newest complete version; -1 if there is none."""
        return max((int(p.getParent().getName()[9:]) for p in self._glob("versions/_version=*/_SUCCESS")), default=-1)

    def places(self, version: int | None = None) -> tuple[dict[str, int], StructType | None]:
        """Which version holds each partition folder, and the schema."""
        n = self.version() if version is None else version
        if n < 0:
            return {}, None
        rows = self.spark.read.schema(PLACES).json(f"{self.path}/versions/_version={n}").collect()
        kind = next(r.kind for r in rows if r.kind is not None)
        return {r.place: r.v for r in rows if r.place is not None}, StructType.fromJson(json.loads(kind))

    def _rows(self, places: dict[str, int], schema: StructType) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/data/_version={v}/{p}" for p, v in sorted(places.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).select(*schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        places, schema = self.places(version)
        if schema is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._rows(places, schema)

    def _folders(self, rows: DataFrame) -> set[str]:
        """Folder names of the partitions that rows fall in."""
        values = [r[0] for r in rows.select(F.col(self.partition).cast("string")).distinct().collect()]
        name = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        return {name(self.partition, v) for v in values}

    def _commit(self, rows: DataFrame, kept: dict[str, int]) -> None:
        """Writes rows as a new version beside the partitions that stay where they are."""
        n = self.version() + 1
        rows.write.mode("overwrite").partitionBy(self.partition).parquet(f"{self.path}/data/_version={n}")
        made = {p.getName(): n for p in self._glob(f"data/_version={n}/{self.partition}=*")}
        listed = [(p, v, None) for p, v in sorted({**kept, **made}.items())] + [(None, None, rows.schema.json())]
        # fails if another writer was first; what a failed writer left of the list goes
        if self._glob(f"versions/_version={n}") and not self._glob(f"versions/_version={n}/_SUCCESS"):
            mode = "overwrite"
        else:
            mode = "errorifexists"
        self.spark.createDataFrame(listed, PLACES).coalesce(1).write.mode(mode).json(f"{self.path}/versions/_version={n}")

    # --- changes

    def replace(self, rows: DataFrame) -> None:
        """All rows anew."""
        self._commit(rows, {})

    def change(self, new: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """``merge(old, new)`` over the partitions where rows of ``new`` or their keys are."""
        places, schema = self.places()
        if schema is None:
            return self._commit(merge(self.spark.createDataFrame([], new.schema), new), {})
        met = self._rows(places, schema).select(*keys, self.partition).join(new.select(*keys), list(keys), "left_semi")
        touched = self._folders(new.select(self.partition).union(met.select(self.partition)))
        old = self._rows({p: v for p, v in places.items() if p in touched}, schema)
        self._commit(merge(old, new).select(*schema.names), {p: v for p, v in places.items() if p not in touched})

    def upsert(self, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> None:
        """Insert or replace by key: the new row wins, then the last under ``order``."""
        def merge(old, rows):
            both = old.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)), allowMissingColumns=True)
            return ordered.latest(both, keys, ["_new", *order]).select(*old.columns)

        self.change(new, keys, merge)

    def first_wins(self, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
        """Insert if absent: of all rows ever seen the first under ``order`` stays, in whatever order they come."""
        self.change(new, keys, lambda old, rows: ordered.first(old.unionByName(rows), keys, order).select(*old.columns))

    def replace_keys(self, fetched: DataFrame, keys: Sequence[str]) -> None:
        """All rows of a re-fetched key give way to the fetched ones."""
        from fungo.sources.planners import replace_by_fetched_keys

        self.change(fetched, keys, lambda old, rows: replace_by_fetched_keys(old, rows, keys))
