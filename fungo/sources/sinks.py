"""Reports, logs, policies and plain tables on disk; tables that change by key are in ``versions``.

A write that also reads its target goes through a checkpoint in the shared folder,
never through a local copy, so a lost executor cannot leave half a table behind the
read.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from fungo.operators import ordered
from fungo.session import checkpoint_root
from fungo.sources.versions import VersionedTable


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _detached(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def replace_table(df: DataFrame, path: str, reads_target: bool = False) -> None:
    (_detached(df) if reads_target else df).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def registry_append(spark: SparkSession, path: str, entry: DataFrame, key: str = "model_id", order: Sequence[str] = ()) -> VersionedTable:
    """One row per model, the newest entry; a registry is one small partition."""
    table = VersionedTable(spark, path, "_all")
    table.upsert(entry.withColumn("_all", F.lit(0)), [key], order)
    return table


def write_checked(df: DataFrame, path: str, checks: Mapping[str, Column]) -> dict[str, int]:
    """Good rows to ``path``/good, the others with their reason to ``path``/quarantine, in one pass over ``df``.

    ``checks`` maps a reason to the condition of a bad row; the first that holds is the
    row's reason, and a condition that is null does not hold. Returns the number of rows,
    of good rows and of each reason, observed while the rows are written.
    """
    reason = functools.reduce(lambda e, item: e.when(item[1], item[0]), checks.items(), F)
    marked = df.withColumn("reason", reason if checks else F.lit(None).cast("string"))
    seen = Observation()
    bad = F.col("reason").isNotNull()
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(~bad).alias("good"), *[F.count_if(F.col("reason") == r).alias(r) for r in checks])
    marked.withColumn("_part", F.when(bad, "quarantine").otherwise("good")).write.mode("overwrite").partitionBy("_part").parquet(path)
    return seen.get


def read_checked(spark: SparkSession, path: str, good: bool = True) -> DataFrame:
    """Good rows of ``write_checked``, or those in quarantine with their reason."""
    rows = spark.read.parquet(path).filter(F.col("_part") == ("good" if good else "quarantine")).drop("_part")
    return rows.drop("reason") if good else rows


def refresh_partition(df: DataFrame, path: str, partition: str = "year") -> None:
    """Replace only the partitions that the new rows fall in."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def report_sink(report: DataFrame, path: str, fmt: str = "csv") -> None:
    """One file per report; reports are small by construction (a row per group value)."""
    w = report.coalesce(1).write.mode("overwrite")
    w.csv(path, header=True) if fmt == "csv" else w.json(path)


RULES = "name string, rules array<struct<bucket: string, min_edge: double, season_phase: string, min_model_prob: double>>"


def save_policy(rules: DataFrame, name: str, path: str) -> None:
    """A policy as one JSON document. Rules are keyed by bucket and phase: at most 40."""
    keyed = ordered.first(rules, ["bucket", "season_phase"], ["position"], ["position", "min_edge", "min_model_prob"])
    row = F.struct("position", "bucket", "min_edge", "season_phase", "min_model_prob")
    doc = keyed.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: F.struct(
        r["bucket"].alias("bucket"), r["min_edge"].alias("min_edge"), r["season_phase"].alias("season_phase"), r["min_model_prob"].alias("min_model_prob"))).alias("rules"))
    doc.select(F.lit(name).alias("name"), "rules").coalesce(1).write.mode("overwrite").json(path)


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.schema(RULES).json(path)
    return doc.select(F.posexplode("rules").alias("position", "r")).select(
        F.col("r.bucket").alias("bucket"), F.coalesce("r.season_phase", F.lit("all")).alias("season_phase"), F.col("r.min_edge").alias("min_edge"),
        F.coalesce("r.min_model_prob", F.lit(0.0)).alias("min_model_prob"), "position")
