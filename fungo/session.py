"""Session settings shared by tests, the bench and interactive use."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def local_session(cpus: str | int = 8, memory: str = "12g") -> SparkSession:
    """A local session. On a cluster the submit command sets master and sizes."""
    n = str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("fungo")
        .config("spark.sql.shuffle.partitions", "8" if n == "*" else n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Where that is unset, as in tests, a
    folder beside the tables of the warehouse is used, which executors share as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + f"/_scratch/{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root
