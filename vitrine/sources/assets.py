"""Binary image assets (O-06). Pixels are not decoded; the format is read from the header."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading bytes of the image formats that are recognised.
IMAGE_SIGNATURES = {
    "jpeg": "FFD8FF",
    "png": "89504E470D0A1A0A",
    "gif": "47494638",
    "bmp": "424D",
    "tiff": "49492A00",
}


def image_format(content: Column) -> Column:
    """Image format by leading bytes; NULL when the bytes are no known image."""
    head = F.hex(F.substring(content, 1, 12))
    found = F.when(head.startswith("52494646") & F.substring(head, 17, 8).eqNullSafe("57454250"), "webp")
    for name, signature in IMAGE_SIGNATURES.items():
        found = found.when(head.startswith(signature), name)
    return found


def classify_assets(df: DataFrame, content: str = "content") -> DataFrame:
    """Add ``length``, ``format`` and ``ok`` to rows holding raw bytes; NULL bytes fail."""
    return df.withColumns(
        {
            "length": F.octet_length(content).cast("long"),
            "format": image_format(F.col(content)),
        }
    ).withColumn("ok", F.col("format").isNotNull())


def read_assets(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """O-06: ``(path, length, content, format, ok)`` for every file below ``folder``.

    Spark lists no empty files; a record pointing at one finds no asset.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "content")
    )
    return classify_assets(files).select("path", "length", "content", "format", "ok")
