"""Shared-folder handling: where lineage is cut and where round trips are written."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster such a
    folder would be visible to one machine, so a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vitrine-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """Folder below the shared one that holds this application's intermediate tables."""
    return f"{shared_root(spark)}/vitrine-{spark.sparkContext.applicationId}"


_scope: ContextVar[str | None] = ContextVar("vitrine_scratch_scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, unused path for an intermediate table, inside the current scope if any."""
    return f"{_scope.get() or scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def scratch_scope(spark: SparkSession):
    """Tables staged inside this block are deleted at its end.

    Whatever is to outlive the block must be written inside it, to a path taken before.
    """
    folder = scratch_path(spark, "scope")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        delete_path(spark, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables, once its results are written."""
    delete_path(spark, scratch_root(spark))


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table and read it back, which cuts its lineage.

    A written table survives executor loss and, unlike checkpointed blocks, later reads
    prune its columns. The scan carries the known schema, so no file is opened to infer
    one.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a fresh table in the shared folder."""
    return write_table(df, scratch_path(df.sparkSession, label))


def hadoop_path(spark: SparkSession, path: str):
    """``(filesystem, path)`` handles for any URI the cluster can write."""
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()), handle


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, handle = hadoop_path(spark, path)
    return fs.exists(handle)


def list_children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; empty when it does not exist."""
    fs, handle = hadoop_path(spark, path)
    if not fs.exists(handle):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(handle))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, handle = hadoop_path(spark, path)
    fs.delete(handle, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files a stored table consists of."""
    total = 0
    for file in df.inputFiles():
        fs, handle = hadoop_path(df.sparkSession, file)
        total += fs.getFileStatus(handle).getLen()
    return total
