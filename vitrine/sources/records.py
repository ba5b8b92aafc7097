"""JSON-lines scan with line numbers and a malformed-line policy (O-01 to O-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.dynamic import fields_of, is_object, wrapped_fields, wrapped_value
from vitrine.operators.numbering import number_scanned_lines

# The catalogue record (fixed column names).
RECORD_FIELDS = [
    "name",
    "series",
    "rarity",
    "origin",
    "edition",
    "release_date",
    "original_price",
    "sku",
    "description",
    "image_url",
    "tags",
]
RECORD_SCHEMA = ", ".join(
    f"{name} {'array<string>' if name == 'tags' else 'string'}" for name in RECORD_FIELDS
)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """O-01: ``(line_no, raw)``, one row per text line, numbered through the files by path.

    The number is unique over the whole input and serves as the record order.
    """
    scan = spark.read.text(path).withColumnRenamed("value", "raw")
    return number_scanned_lines(scan).withColumn("raw", F.rtrim(F.col("raw"), F.lit("\r")))


def read_records(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA) -> DataFrame:
    """O-01: typed scan for trusted files; the raw line stays for error reports.

    Field kinds are coerced to ``schema``. Where the JSON kind matters use
    :func:`parse_records`, which keeps it.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "raw")
    return lines.select("raw", F.from_json("raw", schema).alias("r")).select("raw", "r.*")


def classify_lines(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``fields`` (map of variants) and ``reason`` (NULL when the line is a record).

    One parse per line. Filtering on ``reason`` afterwards would push the parse into the
    filter and repeat it, so flows stage this result before they split it.
    """
    value = F.col("_value")
    parsed = lines.withColumn("_wrapped", wrapped_fields(F.col(raw)))
    parsed = parsed.withColumn("_value", wrapped_value(F.col("_wrapped")))
    reason = (
        F.when(value.isNull(), "invalid_json").when(~is_object(value), "not_an_object")
    )
    return parsed.withColumns({"fields": fields_of(value), "reason": reason}).drop("_value", "_wrapped")


def parse_records(
    lines: DataFrame, on_bad: str = "quarantine", raw: str = "raw"
) -> tuple[DataFrame, DataFrame]:
    """O-02: ``(good, bad)`` under one of three policies.

    ``fail`` raises at run time on the first malformed line, ``quarantine`` returns the
    malformed lines with their reason, ``skip`` returns no bad rows.
    """
    if on_bad not in ("fail", "quarantine", "skip"):
        raise ValueError(f"unknown policy {on_bad!r}")
    classified = classify_lines(lines, raw)
    if on_bad == "fail":
        message = F.concat(F.col("reason"), F.lit(": "), F.col(raw))
        checked = F.when(F.col("reason").isNull(), F.col("fields")).otherwise(
            F.raise_error(message)
        )
        good = classified.withColumn("fields", checked).drop("reason")
        return good, classified.filter(F.lit(False))
    good = classified.filter(F.col("reason").isNull()).drop("reason")
    bad = classified.filter(F.col("reason").isNotNull()).drop("fields")
    return good, bad if on_bad == "quarantine" else bad.filter(F.lit(False))
