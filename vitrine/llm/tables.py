"""Input tables and column names the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one narrow key column that may be broadcast.
FEW_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant of it that clashes with no column of ``df``."""
    names = {c.lower() for c in df.columns}
    return wanted if wanted.lower() not in names else f"{wanted}_{uuid.uuid4().hex[:8]}"


def few_rows(keys: DataFrame) -> DataFrame:
    """``keys``, a stored narrow table, marked for broadcast if it has few rows."""
    return F.broadcast(keys) if keys.limit(FEW_ROWS + 1).count() <= FEW_ROWS else keys


def id_type(docs: DataFrame, column: str = "doc_id") -> str:
    return docs.schema[column].dataType.simpleString()
