"""Bounded samples of labelled rows, on which the models of this package are fitted."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_GRAIN = 1 << 30


def fold(doc_id: str, folds: int) -> Column:
    """Fold of a document: the CRC-32 of its id as text, modulo ``folds``."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def class_sample(rows: DataFrame, label: str, key: str, per_class: int) -> tuple[DataFrame, dict]:
    """About ``per_class`` rows of each label, all of them if there are fewer; and the counts.

    Rows are chosen by a hash of ``key``, so the same rows are chosen whatever the partitions.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col(label) == name, math.ceil(_GRAIN * min(1.0, per_class / n))).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_GRAIN)) < share), counts
