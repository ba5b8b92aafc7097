"""Registered queries and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its function name, with its SQL where SQL can express it."""

    def add(run):
        key = name or run.__name__
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed_point(vector: Column, digits: int = 6) -> Column:
    """A vector as text of scaled integers, the same in every engine."""
    scale = float(10**digits)
    return F.array_join(
        F.transform(vector, lambda x: F.round(x * F.lit(scale)).cast("long").cast("string")), ","
    )
