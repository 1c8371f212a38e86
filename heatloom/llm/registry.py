"""Queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from heatloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, root)`` under ``name``."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
