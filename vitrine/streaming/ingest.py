"""Streaming ingest of JSON-line files (O-53)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vitrine.plans.flows import check_lines


def stream_records(
    spark: SparkSession, folder: str, id_field: str = "name", files_per_batch: int = 1000
) -> DataFrame:
    """O-53: files of a folder as a stream of classified, cleaned and checked records.

    The same column functions as the batch flow: ``raw``, ``fields``, ``id``,
    ``image_url`` and ``reason`` (NULL for a good record). Stateless, so no watermark.
    """
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(folder)
        .withColumnRenamed("value", "raw")
    )
    return check_lines(lines, id_field)


def run_available(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Process everything that has arrived, append it to a Parquet table, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def start_batches(stream: DataFrame, checkpoint: str, handle) -> StreamingQuery:
    """Hand every micro-batch to ``handle(df, batch_id)`` until all input is processed."""
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
