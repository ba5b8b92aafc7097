"""Parallelism of inputs that are small in bytes but dear per row."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Spark's own floor for a file split (spark.sql.files.openCostInBytes).
MIN_SPLIT_BYTES = 4 * 1024 * 1024


def planned_bytes(df: DataFrame) -> int:
    """Size of a plan's output as estimated by the optimizer from file sizes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def input_bytes(df: DataFrame) -> int:
    """Bytes a plan reads, summed over its scans; joins do not multiply it."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [leaves.apply(n).stats().sizeInBytes() for n in range(leaves.size())]
    return sum(int(str(size)) for size in sizes)


def spread_small(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the input is below one smallest split per core.

    A single file with one row group lands in one task however many cores there are. For
    parsing and models that is the whole cost, while shuffling so few bytes is none. A
    larger input already has a split per core and is returned as it is.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_bytes(df) < cores * MIN_SPLIT_BYTES else df
