"""End-to-end flows: pages to records, records to index entries, vector to shown result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.dynamic import (
    metadata_except,
    replace_text,
    scalar_metadata,
    text_field,
)
from vitrine.functions.text import abbreviate, ascii_id, coalesce_text, year_or_self
from vitrine.functions.vectors import hybrid, l2_normalize
from vitrine.operators.extract import CATALOGUE_SPEC, extract_records
from vitrine.operators.joins import lookup
from vitrine.operators.keyed import keep_last
from vitrine.operators.neardup import drop_near_dups, signature_buckets
from vitrine.operators.numbering import BATCH_SIZE, batch_no
from vitrine.operators.topk import attach_metadata, present, topk, topk_batch
from vitrine.operators.validate import judge, record_rules, vector_rules
from vitrine.operators.vectors import embed
from vitrine.session import scratch_path, scratch_scope, stage, write_table
from vitrine.sources.index_store import VectorIndex
from vitrine.sources.records import classify_lines


def clean_columns(records: DataFrame) -> DataFrame:
    """Release date to year and edition to its short form, on string columns (O-21, O-22)."""
    return records.withColumns(
        {
            "release_date": year_or_self(F.col("release_date")),
            "edition": abbreviate(F.col("edition")),
        }
    )


def clean_fields(df: DataFrame, fields: str = "fields") -> DataFrame:
    """The same two rules on dynamic fields: absent and non-string values stay as they are."""
    cleaned = replace_text(F.col(fields), "release_date", year_or_self)
    return df.withColumn(fields, replace_text(cleaned, "edition", abbreviate))


def records_from_pages(
    pages: DataFrame, spec: dict[str, tuple] = CATALOGUE_SPEC, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Landed detail pages to cleaned records; no shuffle."""
    return clean_columns(extract_records(pages, spec, keep))


def check_lines(lines: DataFrame, id_field: str = "name", raw: str = "raw") -> DataFrame:
    """Parse, clean, take the id, then check id before URL.

    Adds ``fields``, ``id``, ``image_url`` and ``reason``; a good record has no reason.
    """
    cleaned = clean_fields(classify_lines(lines, raw))
    keyed = cleaned.withColumns(
        {
            "id": ascii_id(text_field(F.col("fields"), id_field)),
            "image_url": text_field(F.col("fields"), "image_url"),
        }
    )
    return judge(keyed, record_rules(F.col("id"), F.col("image_url")))


def _with_vectors(lines: DataFrame, vectors: DataFrame, dim: int, id_field: str) -> DataFrame:
    """Checked lines with their vector and final reason, as a written table.

    Both the entries and the rejects are read from it, so nothing is parsed or joined
    twice. A reject keeps its raw line, a good row its fields.
    """
    spark = lines.sparkSession
    path = scratch_path(spark, "judged")
    with scratch_scope(spark):
        checked = stage(check_lines(lines, id_field), "checked")
        joined = lookup(checked, vectors.select("image_url", "embedding"), "image_url")
        judged = judge(joined, vector_rules(F.col("embedding"), dim))
        good = F.col("reason").isNull()
        return write_table(
            judged.select(
                "line_no",
                "id",
                "reason",
                F.when(~good, F.col("raw")).alias("raw"),
                F.when(good, F.col("fields")).alias("fields"),
                F.when(good, F.col("embedding")).alias("embedding"),
            ),
            path,
        )


def simple_entries(
    lines: DataFrame, vectors: DataFrame, dim: int, id_field: str = "name"
) -> tuple[DataFrame, DataFrame]:
    """Numbered lines to index entries, last wins: ``(entries, rejects)``.

    ``vectors`` maps ``image_url`` to ``embedding``. Metadata keep their scalar fields only.
    Entries are ``(id, embedding, metadata, line_no)``, rejects ``(line_no, raw, reason)``.
    """
    judged = _with_vectors(lines, vectors, dim, id_field)
    entries = judged.filter("reason IS NULL").select(
        "id", "embedding", scalar_metadata(F.col("fields")).alias("metadata"), "line_no"
    )
    rejects = judged.filter("reason IS NOT NULL").select("line_no", "raw", "reason")
    return keep_last(entries, "id", "line_no"), rejects


def full_entries(
    lines: DataFrame,
    image_vectors: DataFrame,
    make_text_model: Callable,
    dim: int,
    top_m: int = 100,
    id_field: str = "name",
) -> tuple[DataFrame, DataFrame]:
    """Numbered lines to hybrid index entries, first wins: ``(entries, rejects)``.

    ``image_vectors`` maps ``image_url`` to the mean ``embedding`` of the image's variants.
    Near-duplicates and repeated ids are dropped in line order among rows that passed every
    check, and a row that is both counts as a near-duplicate; then the text of ``description``
    is embedded and mixed in. Rejects of these later steps carry no raw line.
    """
    judged = _with_vectors(lines, image_vectors, dim, id_field)
    bad = judged.filter("reason IS NOT NULL")
    fit = judged.filter("reason IS NULL").drop("reason")
    fit = stage(fit.withColumn("signature", signature_buckets(F.col("embedding"), top_m)), "signed")
    # An id already taken by a kept row drops a record just as a shared bucket does, so the
    # id enters the walk as one more bucket.
    buckets = F.concat("signature", F.array(F.xxhash64(F.lit("id"), "id")))
    kept, dropped = drop_near_dups(fit, "line_no", buckets)
    described = kept.withColumn(
        "description", coalesce_text(text_field(F.col("fields"), "description"))
    )
    texts = embed(described, "description", make_text_model, dim, out="text_embedding")
    mixed = texts.select(
        "line_no",
        "id",
        "raw",
        hybrid(F.col("embedding"), F.col("text_embedding")).alias("embedding"),
        metadata_except(F.col("fields")).alias("metadata"),
    )
    mixed = stage(mixed, "mixed")
    # kept rows share no bucket, so each has one holder
    holders = kept.select(F.explode("signature").alias("bucket"), F.col("line_no").alias("holder"))
    near = (
        lookup(dropped.select("line_no", F.explode("signature").alias("bucket")), holders, "bucket", unique=True)
        .filter("holder < line_no").select("line_no").distinct().withColumn("near", F.lit(True))
    )
    dropped = dropped.join(near, "line_no", "left").withColumn(
        "reason", F.when(F.col("near"), "near_duplicate").otherwise("duplicate_id")
    )
    failed = mixed.filter("embedding IS NULL").withColumn("reason", F.lit("embedding_failed"))
    entries = mixed.filter("embedding IS NOT NULL").drop("raw")
    columns = ["line_no", "raw", "reason"]
    rejects = [part.select(*columns) for part in (bad, dropped, failed)]
    return entries, reduce(DataFrame.unionByName, rejects)


def indexed_per_batch(lines: DataFrame, entries: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """O-41, O-50: ``(batch_no, n_lines, n_indexed)`` of every micro-batch, 0 where none was."""
    marked = lines.select("line_no", F.lit(0).alias("indexed")).unionByName(
        entries.select("line_no", F.lit(1).alias("indexed"))
    )
    return marked.groupBy(batch_no(F.col("line_no"), size).alias("batch_no")).agg(
        F.count_if(F.col("indexed") == 0).alias("n_lines"), F.sum("indexed").alias("n_indexed")
    )


def search_values(
    index: VectorIndex,
    values: DataFrame,
    make_model: Callable,
    k: int = 5,
    variants: int = 1,
    conditions: Mapping | None = None,
) -> DataFrame:
    """Search by assets or texts instead of vectors: ``(query_id, rank, id, score)``.

    ``values`` has ``(query_id, value)``. Every value is embedded as ``variants`` variants, the
    mean of which is brought to unit length and searched for among the entries that fulfil
    the conditions (O-51, O-36, O-37, O-47). A value that cannot be embedded finds nothing.
    """
    embedded = embed(values.select("query_id", "value"), "value", make_model, index.dim, variants, out="mean")
    queries = embedded.select("query_id", l2_normalize(F.col("mean")).alias("query"))
    return topk_batch(index.read(), queries, k, index.metric, conditions)


def _shown(results: DataFrame, entries: DataFrame, metric: str) -> DataFrame:
    """Results with their metadata as text, ranked for display."""
    wide = attach_metadata(results, entries.select("id", "metadata"))
    texts = wide.withColumn(
        "metadata", F.transform_values("metadata", lambda _, v: F.try_variant_get(v, "$", "string"))
    )
    return present(texts, metric=metric)


def search_index(
    index: VectorIndex, query: Sequence[float], k: int = 5, conditions: Mapping | None = None
) -> DataFrame:
    """Search of a stored index: filter, top-k, then metadata from the hit buckets only."""
    if len(query) != index.dim:
        raise ValueError(f"index holds {index.dim} dimensions, the query has {len(query)}")
    results = stage(topk(index.read(), query, k, index.metric, conditions), "results")
    return _shown(results, index.entries_of(results), index.metric)


def search(
    index: DataFrame,
    query: Sequence[float],
    k: int = 5,
    metric: str = "cosine",
    conditions: Mapping | None = None,
) -> DataFrame:
    """Filter, top-k, metadata lookup and display of one query vector.

    ``index`` has ``(id, embedding, metadata)`` with a map of variants.
    """
    return _shown(topk(index, query, k, metric, conditions), index, metric)
