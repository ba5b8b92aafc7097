"""Exact top-k inner products by vector approximation.

Vectors are whole numbers. Every component is also put into one of a few cells of its
dimension, and the cell numbers, a byte a component, are what is scanned: from a cell's ends
follow a least and a greatest possible product with the query. In each block of vectors the
products still possible for the best k are kept with their bounds; over all blocks, the k-th
best lower bound discards most of these; the exact vectors of the rest are read in the order
of their upper bounds until the k-th result beats every bound that is left. A bound that equals
the k-th is decided by the ids, as results are, so vectors whose products tie do not pile up.

Queries and vectors meet in blocks of bounded size, one task each, in one shuffle.
Equal vectors score alike, so only the k + 1 smallest ids of each are scanned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.session import stage

#: Cells of a dimension, fewer than it has values as a rule; vectors and queries of a block.
CELLS = 128
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024
LEAST_BLOCKS = 48


def whole_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, v``: components as ``floor(scale * x)``, rows with an undefined one left out.

    A component beyond 64 bits raises an error that names its vector.
    """
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    rows = vectors.filter("vec_id IS NOT NULL").filter(fine)
    lost = F.raise_error(F.concat(F.lit("a component leaves 64 bits in vector "), F.col("vec_id").cast("string"))).cast("long")
    whole = F.transform(x, lambda e: F.when(F.abs(e * scale) < 2.0**63, F.floor(e * scale)).otherwise(lost))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _check_reach(vectors: DataFrame, queries: DataFrame) -> None:
    """Raise, naming vectors, if a product or a bound could leave 64 bits.

    A bound is at most three times the sum of the greatest products of each dimension.
    """

    def tops(rows: DataFrame, name: str) -> DataFrame:
        x = rows.select(F.size("v").alias("dim"), F.posexplode("v"))
        return x.groupBy("dim", "pos").agg(F.max(F.abs(F.col("col").cast("double"))).alias(name))

    far = tops(vectors, "a").join(tops(queries, "b"), ["dim", "pos"]).groupBy("dim").agg(F.sum(F.col("a") * F.col("b")).alias("reach"))
    wide = far.filter(F.col("reach") >= 2.0**61).select("dim")
    size = F.array_max(F.transform("v", lambda e: F.abs(e.cast("double"))))
    named = vectors.join(F.broadcast(wide), "dim", "left_semi").orderBy(size.desc(), "vec_id").limit(5)
    if ids := [r["vec_id"] for r in named.select("vec_id").collect()]:
        raise ValueError(f"products may leave 64 bits; the vectors with the greatest components are {ids}")


def _cell_ends(vectors: DataFrame, cells: int) -> DataFrame:
    """Per vector length: least component and cell width of each dimension, one narrow row."""
    spread = vectors.select(F.size("v").alias("dim"), F.posexplode("v")).groupBy("dim", "pos").agg(F.min("col").alias("low"), F.max("col").alias("high"))
    ends = F.struct("pos", "low", F.floor((F.col("high") - F.col("low")) / cells + 1).cast("long").alias("width"))
    return spread.groupBy("dim").agg(F.array_sort(F.collect_list(ends)).alias("ends")).select(
        "dim", F.col("ends.low").alias("low"), F.col("ends.width").alias("width")
    )


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floating point where no sum can leave its whole numbers."""
    reach = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if reach < 2**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _scan(k: int):
    """Candidates of one block: those that no k others beat, by their bounds and at a tie by id."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("vec_id")
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "least": pa.array([], pa.int64()), "most": pa.array([], pa.int64())})
        if not len(queries) or not len(vectors):
            return none
        q, cells = _matrix(queries["v"], len(queries)), np.frombuffer(b"".join(vectors["cells"].to_pylist()), np.uint8).reshape(len(vectors), -1)
        low, width = (np.asarray(vectors[c][0].as_py(), np.int64) for c in ("low", "width"))
        if not q.shape[1]:
            base = np.zeros((len(q), len(cells)), np.int64)
        else:
            base = _product(q, low + cells.astype(np.int64) * width)
        up, down = (np.maximum(q, 0) * (width - 1)).sum(axis=1), (np.minimum(q, 0) * (width - 1)).sum(axis=1)
        query_ids, ids = queries["query_id"].to_numpy(), vectors["vec_id"].to_numpy()
        # a cell is never wider than its last value, so bounds are base + [down, up]
        own = query_ids[:, None] == ids[None, :]
        floor = np.iinfo(np.int64).min
        least = np.where(own, floor, base + down[:, None])
        others = len(ids) - own.sum(axis=1)
        bar, last = np.full(len(q), floor), np.zeros(len(q), np.int64)
        enough = np.flatnonzero(others >= k)
        if len(enough):
            held = least[enough]
            bar[enough] = np.partition(held, len(ids) - k, axis=1)[:, len(ids) - k]
            # of those at the bar, the smallest ids fill the k
            ties = np.cumsum(held == bar[enough, None], axis=1, dtype=np.int32)
            last[enough] = ids[(ties >= (k - (held > bar[enough, None]).sum(axis=1))[:, None]).argmax(axis=1)]
        most = base + up[:, None]
        keep = ((most > bar[:, None]) | ((most == bar[:, None]) & (ids <= last[:, None])) | (others < k)[:, None]) & ~own
        i, j = np.nonzero(keep)
        return pa.table({"query_id": pa.array(query_ids[i]), "vec_id": pa.array(ids[j]), "least": pa.array(least[i, j]), "most": pa.array(most[i, j])})

    return run


def _refine(k: int):
    """Exact scores in the order of upper bounds, until the k-th best is certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["query_id", "rank", "vec_id", "score"]
        for batch in batches:
            out = []
            for query_id, query, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                q = np.asarray(query, np.int64)
                best: list[tuple[int, int]] = []
                for c in found:  # greatest upper bound first, then the smaller id
                    if len(best) == k and (-c["most"], c["vec_id"]) > best[-1]:
                        if -c["most"] > best[-1][0]:
                            break
                        continue
                    score = int((q * np.asarray(c["v"], np.int64)).sum())
                    best = sorted([*best, (-score, c["vec_id"])])[:k]
                out += [(query_id, i + 1, vec_id, -score) for i, (score, vec_id) in enumerate(best)]
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return run


def _still_possible(possible: DataFrame, k: int) -> DataFrame:
    """The candidates that no k others beat, over all blocks."""
    nth = Window.partitionBy("query_id").orderBy(F.desc("least"), "vec_id")
    numbered = possible.select("query_id", F.col("least").alias("bar"), F.col("vec_id").alias("last"), F.row_number().over(nth).alias("n"))
    bars = numbered.filter(F.col("n") == k).drop("n")
    kept = F.expr("bar IS NULL OR most > bar OR (most = bar AND vec_id <= last)")
    return possible.join(bars, "query_id", "left").filter(kept).select("query_id", "vec_id", "most")


def top_products(vectors: DataFrame, queries: DataFrame, k: int, cells: int = CELLS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` greatest inner products.

    ``vectors`` and ``queries`` hold ``vec_id, v`` with whole components, as ``whole_vectors``
    gives them. A query meets every vector of its own length but those with its own id; ties go
    to the smaller id, and fewer vectors give fewer rows. Components so great that a product could
    leave 64 bits raise an error that names their vectors.
    Of several vectors under one id the smallest, by component, counts.
    """
    dims = F.size("v").alias("dim")
    stored = vectors.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", dims)
    few = Window.partitionBy("v").orderBy("vec_id")
    distinct = stage(stored.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1).drop("n"), "distinct-vectors")
    asked = stage(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")).select("query_id", "v", dims), "queries")
    _check_reach(distinct, asked)
    n, n_queries = distinct.count(), asked.count()
    blocks = max(LEAST_BLOCKS, -(-n // BLOCK_VECTORS))
    query_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    ends = F.broadcast(_cell_ends(distinct, cells))
    cell = F.transform(
        F.arrays_zip("v", "low", "width"), lambda e: F.floor((e["v"] - e["low"]) / e["width"]).cast("int")
    )
    packed = F.unhex(F.array_join(F.transform(cell, lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    data = (
        distinct.join(ends, "dim").select("vec_id", "dim", "low", "width", packed.alias("cells"))
        .withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
        .withColumn("query_block", F.explode(F.expr(f"sequence(0L, {query_blocks - 1}L)")))
    )
    posed = (
        asked.withColumn("query_block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)))
        .withColumn("block", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    )
    place = ["dim", "block", "query_block"]
    possible = stage(
        posed.groupBy(*place).cogroup(data.groupBy(*place)).applyInArrow(_scan(k), "query_id long, vec_id long, least long, most long"),
        "candidates",
    )
    left = _still_possible(possible, k)
    read = left.join(distinct.select("vec_id", "v"), "vec_id")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("most")).alias("order"), "vec_id", "most", "v")))
    exact = read.groupBy("query_id").agg(listed.alias("found")).join(asked.select("query_id", F.col("v").alias("query")), "query_id")
    return exact.select("query_id", "query", "found").mapInArrow(_refine(k), "query_id long, rank int, vec_id long, score long")
