"""Greedy near-duplicate drop in record order (O-39).

A row is dropped when it shares a bucket with an *earlier row that was kept*. Distance is
never checked again, dropped rows suppress nothing, and connected components would be
wrong: with A:{p}, B:{p,q}, C:{q} the answer keeps A and C.

The distributed form rests on three facts.

* Rows with the same full set of buckets: all but the earliest are dropped whatever
  happens to it. One partial aggregate removes every group of copies before anything
  is joined.
* A row whose buckets hold nobody else is kept. Only contested buckets enter the rounds.
* In each round, a row that is the earliest in all its buckets is kept, and whoever shares
  a bucket with it is dropped. The earliest undecided row always qualifies, so rounds end,
  and a bucket needs only its minimum, never its pairs.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.minhash import BANDS, PERMUTATIONS, ROWS, vector_band_keys
from vitrine.operators.joins import HOT_FLOOR, HOT_SHARE
from vitrine.session import delete_path, scratch_path, scratch_scope, stage, write_table

# Rounds decide by default. With a figure above 0, one task finishes the walk in order once no
# more contested memberships (16 bytes each) are left; a long chain costs a round per link.
TAIL_ROWS = 0


def signature_buckets(
    vector: Column,
    top_m: int = 100,
    permutations: int = PERMUTATIONS,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 1,
) -> Column:
    """Band keys of a vector, its token set being the indices of its largest elements.

    ``top_m`` must stay below the dimension: with all indices every row looks the same.
    """
    return vector_band_keys(vector, top_m, permutations, bands, rows, seed)


def _walk(rows: pd.DataFrame) -> pd.DataFrame:
    """Sequential rule over a bounded remainder: the kept order numbers."""
    taken, kept = set(), []
    for order, buckets in rows.sort_values("order").groupby("order", sort=True)["bucket"]:
        held = set(buckets)
        if taken.isdisjoint(held):
            taken |= held
            kept.append(order)
    return pd.DataFrame({"order": pd.Series(kept, dtype="int64")})


def _members_of(members: DataFrame, buckets: DataFrame, total: int) -> DataFrame:
    """Distinct rows holding one of ``buckets`` (unique, with size ``n``).

    Buckets above the hot share number at most ``1/HOT_SHARE`` and are broadcast; the
    shuffle join sees no bucket larger than that share.
    """
    limit = max(HOT_FLOOR, int(total * HOT_SHARE))
    hot = F.broadcast(buckets.filter(F.col("n") > limit).select("bucket"))
    cold = buckets.filter(F.col("n") <= limit).select("bucket")
    by_broadcast = members.join(hot, "bucket", "left_semi")
    by_shuffle = members.join(hot, "bucket", "left_anti").join(cold, "bucket", "left_semi")
    return by_broadcast.unionByName(by_shuffle).select("order").distinct()


def resolve(members: DataFrame, tail_rows: int = TAIL_ROWS) -> DataFrame:
    """Kept order numbers of contested rows ``(order, bucket)``, by rounds.

    The tables of a round are deleted once the next one is written.
    """
    spark = members.sparkSession
    folder = scratch_path(spark, "rounds")
    degree = members.groupBy("order").agg(F.count(F.lit(1)).alias("degree"))
    number = 0
    current = write_table(members.join(degree, "order"), f"{folder}/{number}/members")
    kept = members.select("order").limit(0)
    while (total := current.count()) > tail_rows:
        lowest = write_table(
            current.groupBy("bucket").agg(
                F.min("order").alias("order"),
                F.min_by("degree", "order").alias("degree"),
                F.count(F.lit(1)).alias("n"),
            ),
            f"{folder}/{number}/minima",
        )
        wins = lowest.groupBy("order").agg(
            F.count(F.lit(1)).alias("won"), F.first("degree").alias("degree")
        )
        winners = write_table(
            wins.filter("won = degree").select("order"), f"{folder}/winners/{number}"
        )
        blocked = lowest.join(winners, "order", "left_semi").select("bucket", "n")
        decided = _members_of(current.select("order", "bucket"), blocked, total)
        undecided = current.join(decided, "order", "left_anti")
        current = write_table(undecided, f"{folder}/{number + 1}/members")
        delete_path(spark, f"{folder}/{number}")
        kept = kept.unionByName(winners)
        number += 1
    if total:
        rest = current.select("order", "bucket", F.lit(0).alias("all")).groupBy("all")
        kept = kept.unionByName(rest.applyInPandas(_walk, "order long"))
    return kept


def kept_orders(signatures: DataFrame, tail_rows: int = TAIL_ROWS) -> DataFrame:
    """Kept order numbers of ``(order, buckets)``; order numbers are unique.

    Rows without buckets collide with nobody: each forms a group of its own.
    """
    buckets = F.coalesce("buckets", F.array().cast("array<long>"))
    sets = signatures.select("order", F.array_sort(F.array_distinct(buckets)).alias("buckets"))
    alone = F.when(F.size("buckets") == 0, F.col("order")).alias("alone")
    groups = sets.groupBy("buckets", alone).agg(F.min("order").alias("order"))
    leaders = stage(groups.select("order", "buckets"), "leaders")
    members = leaders.select("order", F.explode("buckets").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = stage(crowded, "crowded")
    n_members = crowded.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if n_members == 0:
        return leaders.select("order")
    # Rows with a contested bucket, then only their contested memberships.
    limit = max(HOT_FLOOR, int(n_members * HOT_SHARE))
    hot = F.broadcast(crowded.filter(F.col("n") > limit).select("bucket"))
    cold = crowded.filter(F.col("n") <= limit).select("bucket")
    contested = members.join(hot, "bucket", "left_semi").unionByName(
        members.join(hot, "bucket", "left_anti").join(cold, "bucket", "left_semi")
    )
    contested = stage(contested, "memberships")
    winners = resolve(contested, tail_rows)
    free = leaders.select("order").join(contested.select("order").distinct(), "order", "left_anti")
    return free.unionByName(winners)


def near_dup_winners(
    df: DataFrame, order: str, buckets: Column, tail_rows: int = TAIL_ROWS
) -> DataFrame:
    """Order numbers of the rows of ``df`` that stay, as a written one-column table."""
    spark = df.sparkSession
    signatures = df.select(F.col(order).cast("long").alias("order"), buckets.alias("buckets"))
    path = scratch_path(spark, "kept")
    with scratch_scope(spark):
        kept = kept_orders(signatures, tail_rows).withColumnRenamed("order", order)
        return write_table(kept, path)


def drop_near_dups(
    df: DataFrame, order: str, buckets: Column, tail_rows: int = TAIL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """O-39: ``(kept, dropped)`` of ``df`` walked along the unique integer column ``order``.

    ``buckets`` is an array of 64-bit keys, such as :func:`signature_buckets`. Rows without
    any key collide with nobody and are kept. ``df`` is read again for the result, so give
    it a stored table.
    """
    winners = near_dup_winners(df, order, buckets, tail_rows)
    return df.join(winners, order, "left_semi"), df.join(winners, order, "left_anti")
