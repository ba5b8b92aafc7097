"""Row validation with ordered reasons, metadata filters and run counters (O-29, O-30, O-41)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from vitrine.functions.dynamic import kind
from vitrine.functions.vectors import norm

# Reject vocabulary (fixed values), in order of precedence.
REASONS = [
    "invalid_json",
    "not_an_object",
    "missing_id",
    "missing_image_url",
    "asset_unavailable",
    "embedding_failed",
    "bad_dimension",
    "not_finite",
    "zero_norm",
    "duplicate_id",
    "near_duplicate",
]


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """O-29: the reason of the first rule whose condition holds, NULL when none does."""
    reason = F.lit(None).cast("string")
    for name, failed in reversed(rules):
        reason = F.when(F.coalesce(failed, F.lit(False)), name).otherwise(reason)
    return reason


def record_rules(id_col: Column, url_col: Column) -> list[tuple[str, Column]]:
    """The id is checked before the URL; an empty URL counts as missing, an empty id does not."""
    return [
        ("missing_id", id_col.isNull()),
        ("missing_image_url", url_col.isNull() | (url_col == "")),
    ]


def vector_rules(vector: Column, dim: int) -> list[tuple[str, Column]]:
    return [
        ("embedding_failed", vector.isNull()),
        ("bad_dimension", F.size(vector) != dim),
        ("not_finite", F.isnan(norm(vector)) | (norm(vector) == float("inf"))),
        ("zero_norm", norm(vector) == 0),
    ]


def judge(df: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """O-29: set ``reason`` by the first failing rule; a reason already there is kept."""
    reason = first_reason(rules)
    if "reason" in df.columns:
        reason = F.coalesce("reason", reason)
    return df.withColumn("reason", reason)


def validate(
    df: DataFrame, rules: list[tuple[str, Column]]
) -> tuple[DataFrame, DataFrame]:
    """O-29: ``(good, rejects)``; rejects carry ``reason``.

    Both halves are filters over ``df``, so give it a stored table or cheap columns.
    """
    judged = judge(df, rules)
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    return good, judged.filter(F.col("reason").isNotNull())


def count_by(df: DataFrame, status: Column) -> DataFrame:
    """O-41: ``(status, n)`` by a plain aggregate, immune to task retries."""
    return df.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def write_judged(judged: DataFrame, path: str) -> dict[str, int]:
    """O-41: write rows with their ``reason`` and return how many there are of each, ``good`` for none.

    Rows go to ``rejected=false`` and ``rejected=true`` below ``path``. The counts are observed
    where the rows are written, so one job does it all; reasons are those of the vocabulary, and any
    other is counted as ``other``.
    """
    counted = Observation()
    known = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    strange = F.count_if(~F.col("reason").isin(REASONS)).alias("other")
    rows = judged.withColumn("rejected", F.col("reason").isNotNull())
    rows = rows.observe(counted, F.count_if(F.col("reason").isNull()).alias("good"), *known, strange)
    rows.write.partitionBy("rejected").parquet(path)
    return {name: n for name, n in counted.get.items()}


_COMPARE = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(*v) if v else F.lit(False),
    "$nin": lambda c, v: ~c.isin(*v) if v else F.lit(True),
}


def _operand(field: str, value, columns: list[str], metadata: str) -> Column:
    """A typed column where the field has one, else the metadata entry of the same kind.

    Beside metadata, ``id`` and ``embedding`` name entries of it and not the index's own columns.
    """
    if field in columns and not (metadata in columns and field in ("id", "embedding", metadata)):
        return F.col(field)
    sample = next(iter(value), None) if isinstance(value, (list, tuple)) else value
    entry = F.try_element_at(F.col(metadata), F.lit(field))
    if isinstance(sample, bool):
        wanted, spark_type = "boolean", "boolean"
    elif isinstance(sample, (int, float)):
        wanted, spark_type = "number", "double"
    else:
        wanted, spark_type = "string", "string"
    return F.when(kind(entry) == wanted, F.try_variant_get(entry, "$", spark_type))


def compile_filter(
    conditions: Mapping | None, columns: list[str], metadata: str = "metadata"
) -> Column:
    """O-30: nested mapping ``{field: {operator: literal}}`` to one predicate.

    All conditions must hold. None and ``{}`` accept every row. A missing field or one of
    another kind matches nothing. Conditions on real columns reach the Parquet scan.
    """
    predicate = F.lit(True)
    for field, tests in (conditions or {}).items():
        if not isinstance(tests, Mapping):
            tests = {"$eq": tests}
        for name, value in tests.items():
            if name not in _COMPARE:
                raise ValueError(f"unknown filter operator {name!r}")
            predicate = predicate & _COMPARE[name](_operand(field, value, columns, metadata), value)
    return predicate
