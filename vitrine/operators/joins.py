"""Joins against a side with one row per key, safe when one key dominates (O-31 to O-33)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vitrine.session import stage, stored_bytes

# A key is hot above this share of the rows, so there are at most 1/HOT_SHARE hot keys. Adaptive
# execution splits what is left of large partitions.
HOT_SHARE = 0.0001
# Stored size up to which the hot keys' rows of the other side are broadcast.
HOT_BYTES = 32 * 1024 * 1024
# Below this row count a key is never worth separate treatment.
HOT_FLOOR = 100_000
SALT, SALTS = "_salt", "_salts"


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys holding more than ``HOT_SHARE`` of the rows: a bounded set, safe to broadcast.

    ``salts`` says over how many parts a key is to be dealt so that none exceeds that share, in
    all at most ``2 / HOT_SHARE``.
    """
    limit = max(HOT_FLOOR, df.agg(F.count(key)).first()[0] * HOT_SHARE)
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    return counts.filter(F.col("count") > limit).select(key, F.ceil(F.col("count") / limit).cast("long").alias("salts"))


def lookup(big: DataFrame, small: DataFrame, key: str, unique: bool = False) -> DataFrame:
    """Left join to ``small``, which has one row per ``key``, plus a ``found`` flag.

    A repeated key raises; ``unique`` says that there is none and spares the check. Rows of hot
    keys meet their match by broadcast and are not shuffled, if those matches are small as
    stored, and are dealt over salts otherwise, for each of which the match is repeated. Rows
    without a key are not shuffled. The shuffle join, which Spark turns into a broadcast where
    ``small`` is small, serves the rest, where no key is large. ``big`` is read once per
    branch, so give it a stored table.
    """
    if not unique:
        repeated = small.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"{key} {repeated[0][key]!r} occurs {repeated[0]['count']} times where one is allowed")
    values = [c for c in small.columns if c != key]
    flagged = small.withColumn("found", F.lit(True))
    found = F.coalesce("found", F.lit(False)).alias("found")
    columns = [F.col(c) for c in [*big.columns, *values]] + [found]
    large = big.limit(HOT_FLOOR + 1).count() > HOT_FLOOR
    keys = hot_keys(big, key).collect() if large else []
    if not keys:
        return big.join(flagged, key, "left").select(*columns)
    names = big.sparkSession.createDataFrame([(r[key], r["salts"]) for r in keys], _salted_schema(small, key))
    hot = stage(flagged.join(F.broadcast(names), key), "hot")
    is_hot = F.col(key).isin([r[key] for r in keys])
    cold = big.filter(~is_hot).join(flagged, key, "left").select(*columns)
    if stored_bytes(hot) <= HOT_BYTES:
        spared = big.filter(F.coalesce(is_hot, F.lit(True))).join(F.broadcast(hot.drop(SALTS)), key, "left")
        return spared.select(*columns).unionByName(cold)
    # wide matches are repeated once for each salt of their key instead, and rows dealt over the salts
    repeated = hot.withColumn(SALT, F.explode(F.sequence(F.lit(0).cast("long"), F.col(SALTS) - 1))).drop(SALTS)
    dealt = big.filter(is_hot).join(F.broadcast(names), key).withColumn(SALT, F.monotonically_increasing_id() % F.col(SALTS))
    salted = dealt.join(repeated.hint("shuffle_hash"), [key, SALT], "left").select(*columns)
    lost = big.filter(F.col(key).isNull()).select(*big.columns, *(F.lit(None).cast(small.schema[c].dataType).alias(c) for c in values), F.lit(False).alias("found"))
    return salted.unionByName(cold).unionByName(lost)


def _salted_schema(small: DataFrame, key: str) -> StructType:
    return StructType([StructField(key, small.schema[key].dataType), StructField(SALTS, LongType())])


def rewrite_urls(
    records: DataFrame, copies: DataFrame, url: str = "image_url"
) -> DataFrame:
    """O-31: replace a URL by that of its successful copy; every record is kept.

    ``copies`` has ``(src_url, ok, new_url)``; of several successful copies of one source
    the greatest ``new_url`` is taken.
    """
    done = (
        copies.filter(F.col("ok") & F.col("src_url").isNotNull())
        .groupBy(F.col("src_url").alias(url))
        .agg(F.max("new_url").alias("_new_url"))
    )
    joined = lookup(records, done, url, unique=True)
    return joined.withColumn(url, F.coalesce("_new_url", url)).select(*records.columns)


def failed_copies(
    records: DataFrame, copies: DataFrame, url: str = "image_url"
) -> DataFrame:
    """O-31: the records whose URL was tried and never copied, ``reason`` ``asset_unavailable``.

    A URL that no copy names was not tried; a record without a URL has nothing to copy.
    """
    tried = (
        copies.filter(F.col("src_url").isNotNull())
        .groupBy(F.col("src_url").alias(url))
        .agg(F.bool_or(F.coalesce("ok", F.lit(False))).alias("_copied"))
    )
    joined = lookup(records, tried, url, unique=True).filter("found AND NOT _copied")
    return joined.select(*records.columns, F.lit("asset_unavailable").alias("reason"))


def asset_manifest(
    records: DataFrame, folder: str, order: str, url: str = "image_url"
) -> DataFrame:
    """O-32: ``(dest, src_url, n_sources, collides)`` for every non-empty URL.

    The destination is the folder plus the URL's base name. Where several URLs share one,
    the last by ``order`` is the one that stays, and ``collides`` is set.
    """
    sources = (
        records.filter(F.coalesce(F.col(url) != "", F.lit(False)))
        .groupBy(F.col(url).alias("src_url"))
        .agg(F.max(order).alias("_last"))
        .withColumn("dest", F.concat(F.lit(folder), F.substring_index("src_url", "/", -1)))
    )
    return (
        sources.groupBy("dest")
        .agg(
            F.max_by("src_url", "_last").alias("src_url"),
            F.count(F.lit(1)).alias("n_sources"),
        )
        .withColumn("collides", F.col("n_sources") > 1)
    )


def attach_embedding(
    records: DataFrame, vectors: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """O-33: ``(good, rejects)``: records with their vector, and those without one.

    ``vectors`` has one row per ``key`` and an ``embedding`` column.
    """
    joined = stage(lookup(records, vectors.select(key, "embedding"), key), "looked-up")
    has_vector = F.col("embedding").isNotNull()
    good = joined.filter(has_vector).drop("found")
    rejects = joined.filter(~has_vector).select(
        *records.columns, F.lit("embedding_failed").alias("reason")
    )
    return good, rejects
