"""Streams over a folder table that arrives in several unordered files."""

import pytest
from pyspark.sql import functions as F

from compare import connect, norm
from fungo import catalog
from fungo.streaming import jobs, run

SF = "/root/testdata/sf0.001"
catalog.load()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest tables; events and orders as folders of three files, the newest rows first."""
    at = tmp_path_factory.mktemp("tables")
    for name, order in (("events", "ts"), ("orders", "o_orderdate")):
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        n = df.count()
        df.coalesce(1).sortWithinPartitions(F.desc(order)).write.option("maxRecordsPerFile", n // 3 + 1).parquet(f"{at}/{name}.parquet")
    for name in ("customer", "lineitem", "nation", "part", "region", "supplier", "documents", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at)


STREAMS = ("quote_windows_tumbling", "quote_windows_sliding", "alert_stream", "alert_time_gate", "season_pct_replay", "pending_settlement", "late_correction", "snapshot_asof_stream",
           "alert_dedupe", "streak_replay")


@pytest.mark.parametrize("each", [None, 1])
@pytest.mark.parametrize("name", STREAMS)
def test_folder_tables(spark, folder, name, each, monkeypatch):
    """All files in one batch, or one file a batch with the newest rows first."""
    read = run.file_stream
    monkeypatch.setattr(run, "file_stream", lambda spark, folder, table, schema: read(spark, folder, table, schema, each))
    df = catalog.QUERIES[name](spark, folder)
    cur = connect(SF).execute(catalog.ORACLE[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([norm(v) for v in r]) for r in cur.fetchall())
    got = sorted(repr([norm(v) for v in r]) for r in df.select(*names).collect())
    assert got == want


def test_one_file_a_batch_loses_nothing(spark, folder, tmp_path):
    events = spark.read.parquet(f"{folder}/events.parquet")
    stream = run.file_stream(spark, folder, "events", events.schema, files_per_batch=1)
    quotes = lambda df: df.select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("game_key"), F.col("value").alias("price"))
    parts = run.drain(quotes(stream), str(tmp_path), prepare=lambda batch, n: jobs.quote_parts(batch, "1 day"))
    assert parts.select("_batch").distinct().count() == 3
    got = jobs.merge_quotes(parts)
    want = jobs.merge_quotes(jobs.quote_parts(quotes(events), "1 day"))
    assert got.agg(F.sum("quotes")).first()[0] == events.where("value is not null").count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
