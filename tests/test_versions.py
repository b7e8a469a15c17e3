"""Tables that change by partition: untouched files, failed writes, keys that move, first rows that win."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from fungo.sources.versions import VersionedTable

DDL = "k int, p string, t int, v string"


def rows_of(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def files(table, place):
    return {(f, os.stat(f).st_mtime_ns) for f in glob.glob(f"{table.path}/data/_version=*/p={place}/*.parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, DDL)
    table = VersionedTable(spark, str(tmp_path / "t"), "p")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.upsert(make([(1, "x", 1, "a"), (2, "y", 1, "b"), (3, "z=1/ %", 1, "c"), (4, None, 1, "d"), (1, "x", 2, "a2")]), ["k"], ["t"])
    before, first = files(table, "y"), {r.k: (r.p, r.t, r.v) for r in table.read().collect()}
    assert first == {1: ("x", 2, "a2"), 2: ("y", 1, "b"), 3: ("z=1/ %", 1, "c"), 4: (None, 1, "d")}
    # an older time still wins, since it is newly written; a key moves from x to z
    table.upsert(make([(1, "z=1/ %", 0, "moved"), (5, "w", 1, "e"), (4, None, 9, "d2")]), ["k"])
    assert {r.k: (r.p, r.t, r.v) for r in table.read().collect()} == {1: ("z=1/ %", 0, "moved"), 2: ("y", 1, "b"), 3: ("z=1/ %", 1, "c"), 4: (None, 9, "d2"), 5: ("w", 1, "e")}
    assert files(table, "y") == before and len(before) > 0
    assert table.places()[0]["p=y"] == 0 and "p=x" not in table.places()[0]
    assert {r.k: (r.p, r.t, r.v) for r in table.read(0).collect()} == first
    table.replace_keys(make([(2, "y", 7, "one"), (2, "y", 8, "two")]), ["k"])
    assert sorted((r.t, r.v) for r in table.read().where("k = 2").collect()) == [(7, "one"), (8, "two")] and table.version() == 2
    table.upsert(make([]), ["k"])
    assert table.read().count() == 6


def test_failed_write_leaves_the_old_version(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), "p")
    table.replace(spark.createDataFrame([(1, "x", 1, "a"), (2, "y", 1, "b")], DDL))
    bad = spark.range(100).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("p"), F.lit(1).alias("t"),
                                  F.when(F.col("id") == 99, F.raise_error(F.lit("no more"))).otherwise(F.lit("n")).cast("string").alias("v"))
    with pytest.raises(Exception, match="no more"):
        table.upsert(bad, ["k"])
    assert table.version() == 0 and rows_of(table) == [(1, "x", 1, "a"), (2, "y", 1, "b")]
    # a list without its success mark is no version, and the next write takes its place
    os.makedirs(f"{table.path}/versions/_version=1")
    open(f"{table.path}/versions/_version=1/part-00000.json", "w").close()
    assert table.version() == 0
    table.upsert(spark.createDataFrame([(1, "x", 2, "c")], DDL), ["k"])
    assert table.version() == 1 and rows_of(table) == [(1, "x", 2, "c"), (2, "y", 1, "b")]


def test_first_wins_in_any_order(spark, tmp_path):
    batches = [[(1, "x", 5, "late"), (2, "y", 3, "b")], [(1, "x", 2, "early"), (2, "y", 9, "no")], [(1, "x", 4, "no"), (1, "x", 2, "tie"), (3, "x", 1, "c")]]
    for turn, order in enumerate([(0, 1, 2), (2, 1, 0), (1, 0, 2), (1, 1, 2, 0, 0)]):
        table = VersionedTable(spark, str(tmp_path / str(turn)), "p")
        for i in order:
            table.first_wins(spark.createDataFrame(batches[i], DDL), ["k"], ["t", "v"])
        assert rows_of(table) == [(1, "x", 2, "early"), (2, "y", 3, "b"), (3, "x", 1, "c")]
