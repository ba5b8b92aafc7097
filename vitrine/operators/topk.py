"""Exact and approximate nearest-neighbour search and its presentation (O-34, O-35, O-45 to O-49)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vitrine.functions.vectors import l2_normalize, matrix, pair_cosine, pair_distance, score
from vitrine.operators.cells import MAX_CELLS, assigned, train
from vitrine.operators.validate import compile_filter
from vitrine.session import stage

# Query vectors held by one task at a time; more are searched block by block.
BLOCK_BYTES = 8 * 1024 * 1024
# An index of at most so many blocks is held by every task while its share of more queries passes.
HELD_BLOCKS = 8
# Vectors of a cell that one task holds while queries pass.
PART_BYTES = 64 * 1024 * 1024
# Score cells a task computes in one matrix product, and elements it takes for exact scores at once.
_CELLS = 4_000_000


def _nearest_first(metric: str) -> Column:
    return F.desc_nulls_last("score") if metric == "cosine" else F.asc_nulls_last("score")


def topk(
    index: DataFrame,
    query: Sequence[float],
    k: int = 5,
    metric: str = "cosine",
    conditions: Mapping | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    metadata: Sequence[str] = (),
    kernel: str = "arrow",
) -> DataFrame:
    """O-45, O-46: the ``k`` nearest entries to one vector: ``(id, score, *metadata)``.

    Conditions apply before the search. Ties go to the smaller id. Every task keeps its
    own ``k`` best rows, so only those are shuffled. ``metadata`` columns ride along;
    :func:`attach_metadata` fetches wide ones after the limit instead. Vectors of another
    length, without a finite length and, with cosine, without direction have no score. The
    ``jvm`` kernel needs no Python workers but three times as long per row.
    """
    candidates = index.filter(compile_filter(conditions, index.columns))
    scored = candidates.select(
        id_col, score(F.col(vec_col), query, metric, kernel).alias("score"), *metadata
    )
    best = scored.orderBy(_nearest_first(metric), F.col(id_col)).limit(k)
    # Undefined scores sort last and go only now: below the limit, this filter would be
    # pushed into the scan and every score computed twice.
    return best.filter(F.col("score").isNotNull())


def attach_metadata(results: DataFrame, index: DataFrame, id_col: str = "id") -> DataFrame:
    """O-35: join wide columns back to the result rows.

    ``results`` is the output of a top-k search and therefore small enough to broadcast;
    the wide side is neither shuffled nor sorted.
    """
    wanted = [c for c in index.columns if c == id_col or c not in results.columns]
    return index.select(*wanted).join(F.broadcast(results), id_col)


class _BlockSearch:
    """Per-task search of one block of queries: matrix products, exact scores, a running top-k.

    A matrix product scores every cell up to a rounding error that is bounded by the lengths of
    the two vectors. Cells that may still enter their query's best ``k`` within that bound
    are scored again pair by pair, by the formula of the single search, and only those exact
    scores are compared, ties going to the smaller id. Higher is nearer for both metrics inside.
    Cosines are multiplied in single precision, the bound being that of its rounding.
    """

    def __init__(self, queries: np.ndarray, query_ids: pa.Array, k: int, metric: str):
        squares = np.square(queries).sum(axis=1)
        usable = np.isfinite(squares) & ((squares > 0) | (metric != "cosine"))
        self.width = queries.shape[1]
        self.queries, self.squares = queries[usable], squares[usable]
        self.query_ids = query_ids.filter(pa.array(usable))
        self.k, self.metric = k, metric
        precision = np.float32 if metric == "cosine" else np.float64
        self.unit = 4 * (self.width + 8) * float(np.finfo(precision).eps)
        if metric == "cosine":
            self.left = (self.queries / np.sqrt(self.squares)[:, None]).astype(precision)
        self.best = (np.empty(0, np.int64), None, np.empty(0))
        self.bar = np.full(len(self.queries), -np.inf)  # exact score of the k-th best so far

    def prepare(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of a batch that can have a score, the squares of their lengths, and their ids."""
        ids, vectors = batch.column(0), batch.column(1)
        width = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy(zero_copy_only=False)
        fits = pa.array(width == self.width)
        ids = ids.filter(fits).to_numpy(zero_copy_only=False)
        if ids.dtype == object:
            ids = ids.astype(str)
        m = matrix(vectors.filter(fits))
        squares = np.square(m).sum(axis=1)
        usable = np.isfinite(squares) & ((squares > 0) | (self.metric != "cosine"))
        return m[usable], squares[usable], ids[usable]

    def rough(self, m: np.ndarray, squares: np.ndarray):
        """Cells in the order of nearness, the error of each, and the bar on the same scale."""
        if self.metric == "cosine":
            right = (m / np.sqrt(squares)[:, None]).astype(self.left.dtype)
            cells = self.left @ right.T
            return cells, np.full((1, 1), self.unit), self.bar
        cells = 2 * (self.queries @ m.T) - squares[None, :] - self.squares[:, None]
        error = self.unit * (squares[None, :] + self.squares[:, None])
        bar = -np.square(self.bar) * (1 + self.unit)
        return cells, error, bar

    def exact(self, q: np.ndarray, m: np.ndarray, squares: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return pair_cosine(m, self.queries[q], squares, self.squares[q])
        return -pair_distance(m, self.queries[q])

    def offer(self, m: np.ndarray, squares: np.ndarray, ids: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            cells, error, bar = self.rough(m, squares)
            cosine = self.metric == "cosine"  # never undefined, and one error holds for all
            sure = np.isneginf(self.bar)
            if sure.any() and cells.shape[1] > self.k:
                least = cells[sure] if cosine else np.nan_to_num(cells[sure] - error[sure], nan=-np.inf)
                bar = bar.copy()
                bar[sure] = np.partition(least, -self.k, axis=1)[:, -self.k] - (error[0, 0] if cosine else 0)
            if cosine:
                near = cells >= (bar - error[0, 0]).astype(cells.dtype)[:, None]
            else:
                near = ~(cells + error < bar[:, None])
            q, column = np.divmod(np.flatnonzero(near), cells.shape[1])
        if not len(q):
            return
        step = max(1, _CELLS // max(1, self.width))
        values = np.concatenate([
            self.exact(q[s : s + step], m[column[s : s + step]], squares[column[s : s + step]])
            for s in range(0, len(q), step)
        ])
        good = np.isfinite(values) & (values >= self.bar[q])
        self.merge(q[good], ids[column[good]], values[good])

    def merge(self, q, ids, values) -> None:
        held_q, held_ids, held_values = self.best
        rest = None
        if held_ids is not None:
            met = np.zeros(len(self.bar), bool)
            met[q] = True
            again = met[held_q]
            rest = held_q[~again], held_ids[~again], held_values[~again]
            q, values = np.concatenate([held_q[again], q]), np.concatenate([held_values[again], values])
            ids = np.concatenate([held_ids[again], ids])
        order = np.lexsort((ids, -values, q))
        q, ids, values = q[order], ids[order], values[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        best = q[keep], ids[keep], values[keep]
        self.best = best if rest is None else tuple(np.concatenate(pair) for pair in zip(rest, best))
        full = place == self.k - 1
        self.bar[q[full]] = values[full]

    def run(self, batches):
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            self.offer_all(*self.prepare(batch))
        yield from self.results(id_type)

    def offer_all(self, m: np.ndarray, squares: np.ndarray, ids: np.ndarray) -> None:
        step = max(1, _CELLS // max(1, len(self.bar)))
        for s in range(0, len(m) if len(self.bar) else 0, step):
            self.offer(m[s : s + step], squares[s : s + step], ids[s : s + step])

    def results(self, id_type: pa.DataType | None) -> Iterator[pa.RecordBatch]:
        q, ids, values = self.best
        if ids is not None and len(q):
            yield pa.RecordBatch.from_arrays(
                [
                    self.query_ids.take(pa.array(q)),
                    pa.array(ids, id_type),
                    pa.array(values if self.metric == "cosine" else -values, pa.float64()),
                ],
                names=["query_id", "id", "score"],
            )


def _found_in_held(index: pa.Table, k: int, metric: str):
    """Search a held index for the queries of every batch, ``(query_id, query)``; nothing is shuffled.

    Queries come in squares of score cells, and a query is searched among the vectors of its length.
    """
    id_type = index.schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, prepared = index.combine_chunks().to_batches(), {}
        for batch in batches:
            lengths = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for width in np.unique(lengths[lengths > 0]):
                fits = batch.filter(pa.array(lengths == width))
                step = max(1, min(int(_CELLS**0.5), BLOCK_BYTES // (8 * int(width))))
                for s in range(0, len(fits), step):
                    part = fits.slice(s, step)
                    search = _BlockSearch(matrix(part.column(1)), part.column(0), k, metric)
                    if width not in prepared:
                        prepared[width] = [search.prepare(b) for b in held]
                    for piece in prepared[width]:
                        search.offer_all(*piece)
                    yield from search.results(id_type)

    return run


def _search_sorted(k: int, metric: str, kinds: tuple[pa.DataType, pa.DataType]):
    """Search groups of rows that come one after the other: a part of a cell, then its queries.

    The part is held, at most ``PART_BYTES`` as a rule; queries pass through in blocks.
    """
    id_type, query_type = kinds
    schema = pa.schema([("query_id", query_type), ("id", id_type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, asked, size = None, [], [], 0

        def found() -> Iterator[pa.RecordBatch]:
            if not held or not asked:
                return
            block = pa.Table.from_batches(asked)
            search = _BlockSearch(matrix(block["vector"].combine_chunks()), block["query_id"].combine_chunks(), k, metric)
            for batch in search.run(held):
                yield pa.RecordBatch.from_arrays(batch.columns, schema=schema)

        for batch in batches:
            cell, part, kind = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            turn = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            for s, e in zip(turn, np.r_[turn[1:], len(batch)]):
                if group != (cell[s], part[s]):
                    yield from found()
                    group, held, asked, size = (cell[s], part[s]), [], [], 0
                rows = batch.slice(s, e - s)
                if kind[s] == 0:
                    held.append(rows.select(["id", "vector"]))
                    continue
                asked.append(rows.select(["query_id", "vector"]))
                size += asked[-1].nbytes
                if size > BLOCK_BYTES:
                    yield from found()
                    asked, size = [], 0
        yield from found()

    return run


def _vector_bytes(rows: DataFrame, column: str) -> int:
    size = F.sum(F.coalesce(F.size(column), F.lit(0)).cast("long") * 8 + 64)
    return rows.agg(F.coalesce(size, F.lit(0)).alias("bytes")).first()["bytes"]


def search_visits(rows: DataFrame, visits: DataFrame, k: int, metric: str) -> DataFrame:
    """``(query_id, id, score)``: the ``k`` best of every cell for the queries that visit it.

    ``rows`` is ``(id, embedding, cell)``, ``visits`` is ``(query_id, query, cell)``. Rows are
    shuffled once however many queries there are. A cell above ``PART_BYTES`` is split into
    parts, and only its visits are repeated for them.
    """
    size = (F.coalesce(F.size("embedding"), F.lit(0)).cast("long") * 8 + 64).alias("bytes")
    sizes = rows.groupBy("cell").agg(F.sum(size).alias("bytes"))
    parts = stage(sizes.select("cell", F.ceil(F.col("bytes") / PART_BYTES).cast("long").alias("parts")), "cell-parts")
    held = rows.join(F.broadcast(parts), "cell").select(
        "cell", F.pmod(F.xxhash64("id"), "parts").alias("part"), F.lit(0).alias("kind"), "id", "embedding", F.lit(None).alias("query_id")
    )
    asked = visits.join(F.broadcast(parts), "cell").select(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"),
        F.lit(None).alias("id"), "query", "query_id",
    )
    id_type, query_type = rows.schema["id"].dataType, visits.schema["query_id"].dataType
    columns = ["cell", "part", "kind", F.col("id").cast(id_type).alias("id"), F.col("embedding").cast("array<double>").alias("vector"),
               F.col("query_id").cast(query_type).alias("query_id")]
    asked = asked.withColumnRenamed("query", "embedding")
    both = held.select(columns).unionByName(asked.select(columns)).repartition("cell", "part").sortWithinPartitions("cell", "part", "kind")
    out = f"query_id {query_type.simpleString()}, id {id_type.simpleString()}, score double"
    return both.mapInArrow(_search_sorted(k, metric, (to_arrow_type(id_type), to_arrow_type(query_type))), out)


def ranked(found: DataFrame, k: int, metric: str) -> DataFrame:
    """The ``k`` best of every query, ties to the smaller id: ``(query_id, rank, id, score)``."""
    per_query = Window.partitionBy("query_id").orderBy(_nearest_first(metric), F.col("id"))
    numbered = found.withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
    return numbered.select("query_id", "rank", "id", "score")


def _apart(score: Column, metric: str) -> Column:
    """The distance between the compared vectors that a score stands for."""
    return F.sqrt(F.greatest(2 - 2 * score, F.lit(0.0))) if metric == "cosine" else score


def _found_by_cells(rows: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Exact search of many queries: pivots, then only cells that can still hold a result.

    Every query first visits the cell of its nearest pivot. Its k-th best there is no nearer than
    its k-th best at all, so other cells matter only if the triangle inequality lets
    them hold something as near. The index moves twice, whatever the number of queries.
    """
    size = _vector_bytes(rows, "embedding")
    pivots = train(queries.withColumnRenamed("query", "embedding"), "embedding", 1, metric, 0)
    wide = rows.filter(F.size("embedding") == pivots.width) if pivots is not None else rows.limit(0)
    pivots = train(wide, "embedding", min(MAX_CELLS, max(16, -(-size // (PART_BYTES // 4)))), metric) if pivots is not None else None
    id_type, query_type = (d.schema[c].dataType.simpleString() for d, c in ((rows, "id"), (queries, "query_id")))
    if pivots is None:
        return rows.sparkSession.createDataFrame([], f"query_id {query_type}, id {id_type}, score double")
    placed = stage(assigned(wide, "embedding", pivots).filter("cell IS NOT NULL"), "cells")
    home = stage(assigned(queries, "query", pivots).filter("cell IS NOT NULL").drop("reach"), "homes")
    radius = np.full(len(pivots.points), -np.inf)
    for cell, reach in placed.groupBy("cell").agg(F.max("reach")).collect():
        radius[cell] = reach
    near = stage(search_visits(placed.drop("reach"), home, k, metric), "home-results")
    bars = near.groupBy("query_id").agg(F.count("*").alias("n"), F.max(_apart(F.col("score"), metric)).alias("bar"))
    bars = bars.select("query_id", F.when(F.col("n") >= k, F.col("bar")).alias("bar"))
    asked = home.join(bars, "query_id", "left").select("query_id", "query", F.col("cell").alias("home"), "bar")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, m = pivots.usable(batch.column(1))
            distance, error = pivots.distances(m)
            bar = batch.column(3).fill_null(np.inf).to_numpy(zero_copy_only=False)[:, None]
            # a score of the k-th is rounded too
            open_to = distance - error - radius[None, :] <= bar + 1e-7 * (1 + bar)
            open_to &= np.isfinite(radius)[None, :]
            open_to[np.arange(len(m)), batch.column(2).to_numpy()] = False
            q, cell = np.nonzero(open_to)
            picked = batch.select([0, 1]).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(cell, pa.int64())], names=["query_id", "query", "cell"])

    visited = stage(asked.mapInArrow(visits, f"query_id {query_type}, query array<double>, cell long"), "visits")
    return near.unionByName(search_visits(placed.drop("reach"), visited, k, metric))


def topk_batch(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    conditions: Mapping | None = None,
    id_col: str = "id",
    vec_col: str = "embedding",
    by_cells: bool | None = None,
) -> DataFrame:
    """O-47: the ``k`` nearest entries to each of many vectors: ``(query_id, rank, id, score)``.

    ``queries`` has ``(query_id, query)``, ids unique and vectors of one length. Up to
    ``BLOCK_BYTES`` of queries go to every task, which multiplies them with its rows and keeps
    ``k`` per query, so the index is neither shuffled nor read twice. With more queries, an index
    of up to ``HELD_BLOCKS`` such blocks after the conditions goes to every task, and the queries stay
    where they are; beyond that, they visit the cells of the index that can hold a result of theirs.
    All give the same rows; ``by_cells`` chooses cells or a block of queries.
    """
    if metric not in ("cosine", "euclidean"):
        raise ValueError(f"unknown metric {metric!r}")
    rows = index.filter(compile_filter(conditions, index.columns)).select(
        F.col(id_col).alias("id"), F.col(vec_col).alias("embedding")
    )
    queries = queries.select("query_id", F.col("query").cast("array<double>").alias("query"))
    queries = stage(queries.filter("query_id IS NOT NULL AND query IS NOT NULL"), "queries")
    out = (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"id {rows.schema['id'].dataType.simpleString()}, score double"
    )
    held = False
    if by_cells is None:
        by_cells = _vector_bytes(queries, "query") > BLOCK_BYTES
        if by_cells:
            rows = stage(rows, "rows")
            held = _vector_bytes(rows, "embedding") <= HELD_BLOCKS * BLOCK_BYTES
    if held:
        found = queries.mapInArrow(_found_in_held(rows.filter("embedding IS NOT NULL").toArrow(), k, metric), out)
    elif not by_cells:
        block = queries.toArrow()
        search = _BlockSearch(matrix(block["query"].combine_chunks()), block["query_id"].combine_chunks(), k, metric)
        found = rows.mapInArrow(search.run, out)
    else:
        found = _found_by_cells(rows, queries, k, metric)
    return ranked(found, k, metric)


def topk_ann(
    index: DataFrame,
    query: Sequence[float],
    k: int = 10,
    id_col: str = "id",
    vec_col: str = "embedding",
    tables: int = 8,
    bucket_length: float = 0.5,
    seed: int = 7,
) -> DataFrame:
    """O-48: approximate cosine top-k: random-projection hashing, then an exact re-rank.

    Unit vectors make Euclidean order equal cosine order.
    """
    unit = index.select(id_col, l2_normalize(F.col(vec_col)).alias("_unit")).filter("_unit IS NOT NULL")
    dense = unit.withColumn("features", array_to_vector("_unit"))
    length = float(np.linalg.norm(query))
    key = [float(x) / length for x in query]
    hasher = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length,
        numHashTables=tables, seed=seed,
    )
    model = hasher.fit(dense)
    target = _dense(key)
    near = model.approxNearestNeighbors(dense, target, k, distCol="distance")
    cosine = 1 - F.col("distance") * F.col("distance") / 2
    return near.select(id_col, cosine.alias("score"))


def _dense(values: Sequence[float]):
    from pyspark.ml.linalg import Vectors

    return Vectors.dense(values)


def present(
    results: DataFrame,
    metadata: str = "metadata",
    metric: str = "cosine",
    id_col: str = "id",
    max_length: int = 100,
) -> DataFrame:
    """O-49: ``(rank, id, score, score_text, image_url, shown)`` for a top-k result.

    ``metadata`` is a map of strings. ``shown`` leaves out the image URL, the embedding
    and texts of ``max_length`` characters or more. The input is a top-k result, so
    ranking it in one place is bounded by ``k``.
    """
    rank = F.row_number().over(Window.orderBy(_nearest_first(metric), F.col(id_col)))
    shown = F.map_filter(
        F.col(metadata),
        lambda k, v: ~k.isin("image_url", "embedding") & (F.length(v) < max_length),
    )
    return results.select(
        rank.alias("rank"),
        id_col,
        F.col("score").cast("double").alias("score"),
        F.format_string("%.4f", F.col("score").cast("double")).alias("score_text"),
        F.try_element_at(F.col(metadata), F.lit("image_url")).alias("image_url"),
        shown.alias("shown"),
    )
