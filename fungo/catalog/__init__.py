"""Registered queries: one per operator, with the SQL that states its answer."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fungo.views import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

FAMILIES = ("windows", "joins", "aggregates", "projections", "scalars", "decisions",
            "ingest", "features", "models", "streams")


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is its oracle."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = oracle(sql, ctes)
        return fn

    return register


def load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"fungo.catalog.{family}")
