"""Listing ranges and landed raw pages (O-04, O-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing_urls(spark: SparkSession, template: str, start: int, end: int) -> DataFrame:
    """O-04: ``(page, url)`` for every page from ``start`` to ``end`` inclusive.

    ``template`` holds one ``%d``.
    """
    pages = spark.range(start, end + 1).withColumnRenamed("id", "page")
    return pages.withColumn("url", F.format_string(template, "page"))


def expand_ranges(ranges: DataFrame, start: str, end: str, url: Column) -> DataFrame:
    """O-04 over a table of ranges: one row per page of every range, ends included.

    ``url`` may refer to the generated ``page`` column.
    """
    pages = F.when(F.col(start) <= F.col(end), F.sequence(F.col(start), F.col(end)))
    return ranges.withColumn("page", F.explode(pages)).withColumn("url", url)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """O-05: landed pages, either a Parquet table or one HTML file per page."""
    if path.rstrip("/").endswith((".html", ".htm", ".txt")) or "*" in path:
        files = spark.read.text(path, wholetext=True)
        return files.select(
            F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
        )
    return spark.read.parquet(path)
