"""Consecutive line numbers and micro-batch numbers without a single-task sort (O-03, O-50)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.partitioning import planned_bytes
from vitrine.session import stage

BATCH_SIZE = 128


# One offset row takes 32 bytes; up to this many are broadcast, beyond it they are shuffled.
MAX_BROADCAST_CHUNKS = 1_000_000


def _with_offsets(df: DataFrame, chunk: list[str], place: list[str], n_chunks: int) -> DataFrame:
    """Number rows from per-chunk counts.

    ``_seq`` rises by one inside a chunk and chunks follow each other along ``place``. Only
    one row per chunk (a file split or a task's output) reaches the window that sums the
    counts.
    """
    counts = df.groupBy(*chunk).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_seq").alias("_first"),
        F.min(F.struct(*place)).alias("_place"),
    )
    before = F.sum("_rows").over(Window.orderBy("_place")) - F.col("_rows")
    offsets = counts.select(*chunk, "_first", before.alias("_before"))
    if n_chunks <= MAX_BROADCAST_CHUNKS:
        offsets = F.broadcast(offsets)
    numbered = df.join(offsets, chunk)
    line_no = F.col("_before") + F.col("_seq") - F.col("_first") + 1
    return numbered.withColumn("line_no", line_no).drop(
        *chunk, *place, "_seq", "_first", "_before"
    )


def split_bytes(df: DataFrame) -> int:
    """Size Spark cuts files into, from ``spark.sql.files.maxPartitionBytes``."""
    setting = df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")
    number, unit = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", setting.strip().lower()).groups()
    return int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def expected_splits(n_files: int, n_bytes: int, split: int) -> int:
    """Upper estimate of the file splits of a scan: one end per file, the rest full."""
    return n_files + n_bytes // split


def number_scanned_lines(scan: DataFrame) -> DataFrame:
    """O-03 for a file scan: add ``line_no``, counting from 1 through all files by path.

    Each file split keeps its rows in order, so numbering needs the row count of every
    split and no shuffle of the lines. Apply directly to the scan.
    """
    located = scan.withColumns(
        {
            "_path": F.col("_metadata.file_path"),
            "_file": F.xxhash64("_metadata.file_path"),
            "_split": F.col("_metadata.file_block_start"),
            "_seq": F.monotonically_increasing_id(),
        }
    )
    splits = expected_splits(len(scan.inputFiles()), planned_bytes(scan), split_bytes(scan))
    return _with_offsets(located, ["_file", "_split"], ["_path", "_split"], splits)


def with_line_no(df: DataFrame, *order: str) -> DataFrame:
    """O-03 for a table: add ``line_no``, counting from 1 along ``order``.

    The order columns together must be unique. Rows are range-partitioned on all of them,
    so no task sees more than its share; the sorted table is written once because range
    bounds are sampled and must not be drawn twice.
    """
    columns = [*order] or df.columns
    ordered = (
        df.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .withColumns({"_task": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()})
    )
    n_tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _with_offsets(stage(ordered, "ordered"), ["_task"], ["_task"], n_tasks)


def batch_no(line_no: Column, size: int = BATCH_SIZE) -> Column:
    """O-50: number of the micro-batch a line falls into, counting from 0."""
    return F.floor((line_no - 1) / size).cast("long")


def with_batch_no(df: DataFrame, size: int = BATCH_SIZE, line_no: str = "line_no") -> DataFrame:
    """O-50: add ``batch_no``; the last batch may be partial."""
    return df.withColumn("batch_no", batch_no(F.col(line_no), size))
