"""One row per key, first or last by order columns (O-43, O-44)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order(columns: tuple[str, ...], last: bool) -> Column:
    """What decides between rows of a key; a null loses to any value, whichever end wins."""
    if len(columns) == 1:
        return F.col(columns[0])
    flags = [(F.col(c).isNotNull() if last else F.col(c).isNull(), F.col(c)) for c in columns]
    return F.struct(*(x for pair in flags for x in pair))


def _one_per_key(df: DataFrame, key: str | list[str], order: tuple[str, ...], last: bool) -> DataFrame:
    """Only keys and order are aggregated; the rows themselves move once, with their match.

    Rows meet on key and order together, so a key that holds a third of all rows is spread out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    tag = uuid.uuid4().hex[:8]
    pick = F.max if last else F.min
    winners = df.groupBy(*(F.col(k).alias(f"_{k}_{tag}") for k in keys)).agg(pick(_order(order, last)).alias(f"_{tag}"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}_{tag}")) for k in keys]
    same.append(_order(order, last).eqNullSafe(F.col(f"_{tag}")))
    return df.join(winners, reduce(lambda a, b: a & b, same), "left_semi")


def keep_last(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """O-43: last wins. ``order`` must not tie within a key; null comes before everything."""
    return _one_per_key(df, key, order, True)


def keep_first(df: DataFrame, key: str | list[str], *order: str) -> DataFrame:
    """O-44: first wins. ``order`` must not tie within a key; null comes after everything."""
    return _one_per_key(df, key, order, False)


def upsert(
    base: DataFrame, updates: DataFrame, key: str, order: str
) -> DataFrame:
    """O-43: ``base`` with the last update per key put in place; ``base`` has unique keys."""
    latest = keep_last(updates, key, order).select(*base.columns)
    return base.join(latest.select(key), key, "left_anti").unionByName(latest)
