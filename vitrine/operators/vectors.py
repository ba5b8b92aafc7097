"""Vector means over rows and pluggable batch embedding (O-36, O-51)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.model_cache import ModelCache
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.joins import lookup
from vitrine.operators.partitioning import spread_small
from vitrine.session import stage

BATCH_SIZE = 128


# Sums of one aggregate; more would leave code generation.
BLOCK = 64


def vec_mean(df: DataFrame, key: str, col: str = "embedding", dim: int | None = None) -> DataFrame:
    """O-36: elementwise mean of all vectors of a key: ``(key, embedding)``.

    Null vectors do not count; a null element, vectors of different lengths, another length
    than ``dim``, or no vector at all make the mean NULL. Sums are combined before the
    shuffle, so a key with a third of the rows costs no more than any other. With ``dim``, a
    key is one row of running sums for every 64 elements; take this for many keys, such as the
    variants of every record. Without it every element becomes a row of the aggregate: as
    fast for few keys, but six times slower with four vectors per key.
    """
    v = F.col(col)
    if dim is None:
        elements = df.select(key, v.isNotNull().alias("real"), F.posexplode_outer(col).alias("pos", "x"))
        means = elements.groupBy(key, "pos").agg(
            F.avg(F.col("x").cast("double")).alias("x"),
            F.count_if("real").alias("n"),
            F.count("x").alias("whole"),
        )
        means = means.filter("n > 0 OR pos IS NULL")
        packed = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "x", "n", "whole"))).alias("e"))
        # an entry without a position stands for null vectors (n = 0) or empty ones
        real = F.filter("e", lambda e: e["pos"].isNotNull())
        fine = (
            (F.size(real) > 0)
            & F.forall(real, lambda e: (e["n"] == real[0]["n"]) & (e["whole"] == e["n"]))
            & ~F.exists("e", lambda e: e["pos"].isNull() & (e["n"] > 0))
        )
        return packed.select(key, F.when(fine, F.transform(real, lambda e: e["x"])).alias(col))
    unfit = F.coalesce((F.size(v) != dim) | F.exists(v, lambda x: x.isNull()), F.lit(False))
    rows = df.select(key, v.alias("_v"), unfit.alias("_unfit"), F.lit(0).alias("_block"))
    blocks = -(-dim // BLOCK)
    if blocks > 1:
        parts = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.struct(b.alias("b"), F.slice("_v", b * BLOCK + 1, BLOCK).alias("p")))
        rows = rows.select(key, "_unfit", F.explode(parts).alias("_e")).select(key, "_unfit", F.col("_e.b").alias("_block"), F.col("_e.p").alias("_v"))
    width = min(dim, BLOCK)
    # SQL text, because building many column objects takes longer than the query.
    sums = rows.groupBy(key, "_block").agg(
        F.count("_v").alias("_n"),
        F.count_if("_unfit").alias("_bad"),
        *[F.expr(f"sum(CAST(get(_v, {n}) AS DOUBLE)) AS _{n}") for n in range(width)],
    )
    mean = F.expr("array(" + ", ".join(f"_{n} / _n" for n in range(width)) + ")")
    fine = (F.col("_bad") == 0) & (F.col("_n") > 0)
    if blocks == 1:
        return sums.select(key, F.when(fine, mean).alias(col))
    merged = sums.select(key, "_block", F.when(fine, mean).alias("_mean")).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_block", "_mean"))).alias("_e")
    )
    whole = F.slice(F.flatten(F.transform("_e", lambda e: e["_mean"])), 1, dim)
    return merged.select(key, whole.alias(col))


def fan_out(df: DataFrame, variants: int) -> DataFrame:
    """One row per variant: ``variant_no`` 0 is the base, the others are augmented."""
    return df.withColumn("variant_no", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))


def embed(
    df: DataFrame,
    col: str,
    make_model: Callable[[], Callable],
    dim: int,
    variants: int = 1,
    out: str = "embedding",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """O-51: add a vector computed by a Python model in batches, NULL on failure.

    ``make_model`` loads the model, once per Python worker. The model takes a list of
    values and a list of variant numbers and returns one vector or None per value. With
    ``variants`` above 1 every value is embedded that often and the vectors are averaged
    in place, so no shuffle is needed; one failed variant makes the result NULL. A batch that
    fails is halved until the bad values are alone, so one of 128 costs 15 calls at most. A filter
    on the vectors stays behind the model, as one moved before it would run the model once more.
    """
    model_key = uuid.uuid4()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = ModelCache.get(model_key)
        if model is None:
            model = make_model()
            ModelCache.add(model_key, model)

        def chunk_vectors(values, variant):
            try:
                return model(values, [variant] * len(values))
            except Exception:  # a bad value must not take its batch down
                if len(values) == 1:
                    return [None]
                half = len(values) // 2
                return [*chunk_vectors(values[:half], variant), *chunk_vectors(values[half:], variant)]

        for series in batches:
            results = []
            for start in range(0, len(series), batch_size):
                values = series.iloc[start : start + batch_size].tolist()
                runs = [chunk_vectors(values, v) for v in range(variants)]
                results.extend(_mean_or_none(vectors, dim) for vectors in zip(*runs))
            yield pd.Series(results, index=series.index, dtype=object)

    # a deterministic function would be copied into filters and repeated where its result is read twice
    return spread_small(df).withColumn(out, run.asNondeterministic()(F.col(col)))


def embed_distinct(
    df: DataFrame,
    col: str,
    make_model: Callable[[], Callable],
    dim: int,
    variants: int = 1,
    out: str = "embedding",
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """O-51 by content: :func:`embed` where every distinct string or binary value is embedded once.

    Values are known by their SHA-256 digest; their vectors are stored and joined back by
    :func:`lookup`, so rows of a hot value are spread out. NULL is a value like any other. Take
    it where values repeat: rows move twice, which costs more than a cheap model does.
    """
    row, digest = "_row", "_digest"
    hashed = F.coalesce(F.sha2(F.col(col).cast("binary"), 256), F.lit(""))
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != out))
    rows = stage(df.select(whole.alias(row), F.col(col).alias("_value"), hashed.alias(digest)), "digests")
    values = rows.groupBy(digest).agg(F.first("_value").alias("_value"))
    vectors = stage(embed(values, "_value", make_model, dim, variants, out, batch_size).select(digest, out), "embedded")
    return lookup(rows.drop("_value"), vectors, digest, unique=True).select(f"{row}.*", out)


def _mean_or_none(vectors, dim: int):
    if any(v is None or len(v) != dim for v in vectors):
        return None
    if len(vectors) == 1:
        return np.asarray(vectors[0], dtype=np.float64)
    return np.mean(np.asarray(vectors, dtype=np.float64), axis=0)
