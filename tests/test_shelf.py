"""Bucketed tables: joins without exchanges, and the number of exchanges of the wide pipelines."""

import os
import time

import pytest
from pyspark.sql import functions as F

from fungo import catalog
from fungo.operators import joins as j, ordered as o
from fungo.sources import shelf as shelves
from fungo.sources.shelf import Shelf

SF = "/root/testdata/sf0.001"
catalog.load()


def exchanges(df):
    """Exchanges that ran, without broadcasts and reused ones."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange " in x and "Broadcast" not in x and "Reused" not in x for x in plan.splitlines())


def test_tables_meet_without_exchanges(spark):
    shelf = Shelf(spark, 4)
    left = shelf.put("left", spark.range(1000).select("id", (F.col("id") % 7).alias("x")), ["id"])
    right = shelf.put_all({n: spark.range(500).select("id", F.lit(n).alias(n)).groupBy("id").agg(F.max(n).alias(n)) for n in ("a", "b")}, ["id"], dealt=False)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = left.join(right[0], "id", "left").join(right[1], "id", "left").groupBy("id").agg(F.max("x").alias("x"), F.count("b").alias("n"))
        assert exchanges(out) == 0
        assert out.agg(F.sum("n"), F.count("*")).first()[:] == (500, 1000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shelf.forget()
    assert left.count() == 1000 and not spark.catalog.tableExists(f"shelf_{shelf.id}_left")


@pytest.mark.parametrize("name,most", [("matchup_rows", 25), ("impact_form", 22), ("full_feature_matrix", 105)])
def test_exchanges_of_all_jobs(spark, monkeypatch, name, most):
    jobs = []

    def put(self, name, df, keys, dealt=False, put=Shelf.put):
        jobs.append(exchanges(df if dealt else df.repartition(self.buckets, *keys)))
        return put(self, name, df, keys, dealt)

    monkeypatch.setattr(Shelf, "put", put)
    last = exchanges(catalog.QUERIES[name](spark, SF))
    assert sum(jobs) + last <= most and last <= 25


def test_union_of_asof_sources(spark):
    day = lambda rows, ddl: spark.createDataFrame(rows, ddl).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d")))
    asks = day([("a", 5), ("a", 5), ("a", 9), ("b", 5), ("c", 1)], "k string, d int").drop("d")
    known = day([("a", 5, 1, 10), ("a", 5, 2, 20), ("a", 4, 9, 30), ("b", 7, 1, 40)], "k string, d int, tie int, v int").withColumnRenamed("day", "at").drop("d")
    outs = day([("a", 4, 3), ("a", 5, 100), ("a", 6, 7), ("a", 2, 50), ("a", 3, None), ("b", 3, 0), ("b", 1, 8)], "k string, d int, outs int").drop("d")
    got = j.asof_union(asks, ["k"], "day", {"upto": j.Source(known, "at", ["v"], tie=["tie"]), "before": j.Source(known, "at", ["v"], inclusive=False, tie=["tie"])}, sums=(outs, "outs", 3))
    rows = sorted((r.k, r.day.day - 1, r.upto and r.upto.v, r.before and r.before.v, r.outs_sum) for r in got.collect())
    assert rows == [("a", 5, 20, 30, 53), ("a", 5, 20, 30, 53), ("a", 9, 20, 20, 7), ("b", 5, None, None, 0), ("c", 1, None, None, None)]


def test_runs_to_end_from_one_reading(spark):
    """Plays that lie by game are summed where they are; a half without a side has no end."""
    from fungo.plans import plays

    rows = [(g, side, n, r) for g in range(6) for side in (0, 1, None) for n, r in enumerate((1, 0, 2))]
    df = spark.createDataFrame(rows, "game_pk long, side int, play int, runs_scored int").repartition(4, "game_pk")
    out = plays.with_runs_to_end(df, ["game_pk", "side"], ["play"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan ExistingRDD") == 1
    got = {(r["side"], r["play"]): (r["runs_before"], r["runs_to_end"]) for r in out.collect()}
    for side in (0, 1):
        assert [got[side, n] for n in range(3)] == [(0, 3), (1, 2), (1, 2)]
    assert [got[None, n][1] for n in range(3)] == [None] * 3


def test_states_are_not_exchanged(spark):
    """Plays meet the table of states without being moved to its few keys."""
    from fungo.plans import plays

    rows = [(g, 0, n, "0_0", "1_0", 1, 1990 + g % 3, n % 2) for g in range(9) for n in range(3)]
    df = spark.createDataFrame(rows, "game_pk long, side int, play int, state_before string, state_after string, outs_after int, season int, runs_scored int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        out = plays.play_values(df, ["game_pk", "side"], ["play"])
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan


def test_season_values_are_read_from_files(spark):
    """The order lines behind the values of a season are read once, when these are written, not at every use."""
    plan = catalog.QUERIES["stuff_attach"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x for x in files.splitlines() if "/shuffle_" in x}


def test_exchanges_of_a_table_go_with_its_job(spark):
    before, setting = shuffle_files(spark), spark.conf.get(shelves.CLEANUP, None)
    shelf = Shelf(spark, 4)
    made = shelf.put("sums", spark.range(1000).groupBy((F.col("id") % 10).alias("id")).agg(F.count("*").alias("n")), ["id"])
    shelf.put_all({"more": made.groupBy("n").agg(F.max("id").alias("id"))}, ["id"], dealt=False)
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)  # files are removed in the background
    assert not shuffle_files(spark) - before
    assert spark.conf.get(shelves.CLEANUP, None) == setting
    assert made.count() == 10


def test_dropped_tables_leave_no_files(spark):
    shelf = Shelf(spark, 2)
    shelf.put("gone", spark.range(10), ["id"])
    kept = shelf.put("kept", spark.range(10), ["id"])
    at = os.path.join(shelf.root.removeprefix("file:"), "")
    assert sorted(os.listdir(at)) == ["gone", "kept"]
    shelf.drop("gone")
    assert os.listdir(at) == ["kept"] and kept.count() == 10
    assert not spark.catalog.tableExists(f"shelf_{shelf.id}_gone") and shelf.names == [f"shelf_{shelf.id}_kept"]


def test_full_matrix_keeps_one_job_on_disk(spark, monkeypatch):
    """Tables are written one at a time, and what only other tables are made of is gone before the matrix is joined."""
    made, running, most = [], [], []

    def put(self, name, df, keys, dealt=False, put=Shelf.put):
        running.append(name)
        most.append(len(running))
        made.append(self)
        try:
            return put(self, name, df, keys, dealt)
        finally:
            running.remove(name)

    monkeypatch.setattr(Shelf, "put", put)
    out = catalog.QUERIES["full_feature_matrix"](spark, SF)
    left = os.listdir(made[0].root.removeprefix("file:"))
    assert max(most) == 1
    assert not set(left) & {"appearances", "runs_to_end", "values", "placed", "batters", "people", "stats"}
    assert len(out.columns) == 148 and out.count() > 0


def test_sides_stay_where_they_lie(spark):
    """Joined near a key, rows get what a join on all keys gives them, and only the other side is moved."""
    rows = [(1, "a", 1), (1, "b", 2), (1, "b", 3), (2, "a", 4), (2, None, 5), (None, "a", 6), (3, "c", 7)]
    values = [(1, "a", 10), (1, "b", 20), (1, "b", 21), (2, "b", 30), (2, None, 40), (None, "a", 50)]
    shelf = Shelf(spark, 4)
    left = shelf.put("rows", spark.createDataFrame(rows, "k long, team string, x int"), ["k"])
    right = spark.createDataFrame(values, "k long, team string, v int")
    key = "spark.sql.autoBroadcastJoinThreshold"
    old, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        near = o.join_near(left, right, ["k", "team"], near=["k"])
        whole = o.join_near(left, right, ["k", "team"])
        order = lambda df: sorted(map(tuple, df.select("k", "team", "x", "v").collect()), key=repr)
        assert order(near) == order(whole)
        assert exchanges(near.groupBy("k").agg(F.max("v"))) == 1 and exchanges(whole.groupBy("k").agg(F.max("v"))) == 3
    finally:
        spark.conf.set(key, old)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_running_sums_near_a_day(spark):
    rows = [(t, v, d, n, n % 3) for t in (1, 2) for d in range(4) for n, v in enumerate("hah")] + [(1, None, 2, 9, 5)]
    df = spark.createDataFrame(rows, "team int, venue string, day int, n int, x int")
    aggs = {"s": ("sum", "x"), "c": ("count", "x")}
    plain, near = (o.expanding(df, ["team", "venue"], ["day", "n"], aggs, near=k) for k in ((), ("team", "day")))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, near.collect()))
