"""File sinks (O-08 to O-11)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.operators.keyed import keep_last
from vitrine.session import list_children, stage


def write_records(df: DataFrame, path: str, mode: str = "append", ascii: bool = False) -> None:
    """O-08: one JSON object per line with nulls written out.

    ``ascii`` escapes every non-ASCII character.
    """
    (
        df.write.mode(mode)
        .option("ignoreNullFields", "false")
        .option("writeNonAsciiCharacterAsCodePoint", str(ascii).lower())
        .json(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """O-09: CSV with a header; arrays, maps and structs go out as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).options(header=True, escape='"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Read back what :func:`write_csv` wrote; quoted values may span lines."""
    options = {"header": True, "escape": '"', "multiLine": True}
    return spark.read.options(**options).schema(schema).csv(path)


def land_pages(df: DataFrame, path: str, order: str, pages_per_folder: int = 1000) -> None:
    """O-10: raw pages keyed by (page, item), the last one by ``order`` wins, added to those landed before.

    Folders hold ranges of pages, so their number stays far below the number of pages. Only
    folders that get a page are written anew, with the pages they held; a page that is landed
    again replaces the earlier one, whatever its ``order``. The merged folders are staged first,
    so a run that fails can be repeated.
    """
    spark = df.sparkSession
    folder = F.floor(F.col("page") / pages_per_folder).cast("long")
    fresh = keep_last(df, ["page", "item"], order).withColumn("page_range", folder)
    if list_children(spark, path):
        fresh = stage(fresh, "landing")
        touched = [r["page_range"] for r in fresh.select("page_range").distinct().collect()]
        before = spark.read.parquet(path).withColumn("page_range", F.col("page_range").cast("long"))
        hit = F.col("page_range").isin([t for t in touched if t is not None])
        before = before.filter(hit | F.col("page_range").isNull() if None in touched else hit)
        replaced = fresh.select(F.col("page").alias("_page"), F.col("item").alias("_item"))
        same = F.col("page").eqNullSafe(F.col("_page")) & F.col("item").eqNullSafe(F.col("_item"))
        fresh = stage(before.join(replaced, same, "left_anti").unionByName(fresh, allowMissingColumns=True), "landing")
    ranged = fresh.hint("rebalance", "page_range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    ranged.partitionBy("page_range").parquet(path)


def write_rejects(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """O-11: rejected rows as JSON lines, replaced per run or appended."""
    write_records(df, path, mode)
