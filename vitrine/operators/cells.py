"""Vectors in cells around trained centroids: the ground of exact and approximate search (O-47, O-48).

A cell is known by its centroid and by the greatest distance of its vectors from it, the
radius. By the triangle inequality no vector of a cell is nearer to a query than the centroid's
distance less the radius. With cosine, vectors are cells of unit vectors, whose distance
``sqrt(2 - 2 cos)`` orders them alike. Distances come from matrix products and carry a bound of
their rounding error, by which every inequality is loosened, so that cells change no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions.vectors import matrix

# Cells at most, and bytes of sampled vectors at most that centroids are trained on.
MAX_CELLS = 4096
SAMPLE_BYTES = 64 * 1024 * 1024
SAMPLE_PER_CELL = 64
ROUNDS = 4
_ROWS_AT_ONCE = 4096


class Centroids:
    """Centroids of one metric; with cosine they and all vectors are brought to unit length."""

    def __init__(self, points: np.ndarray, metric: str):
        self.metric = metric
        self.middle = points.mean(axis=0) if len(points) else np.zeros(points.shape[1])
        # products lose least where the origin lies among the points
        self.points = points - self.middle
        self.squares = np.square(self.points).sum(axis=1)

    @property
    def width(self) -> int:
        return self.points.shape[1]

    def usable(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors have the centroids' length and a direction, and these as they are compared."""
        fits = pa.compute.list_value_length(vectors).fill_null(-1).to_numpy() == self.width
        m = matrix(vectors.filter(pa.array(fits)))
        if not len(m):
            return np.flatnonzero(fits), np.empty((0, self.width))
        with np.errstate(over="ignore", invalid="ignore"):
            squares = np.square(m).sum(axis=1)
        good = np.isfinite(squares) & ((squares > 0) | (self.metric != "cosine"))
        m = m[good]
        if self.metric == "cosine":
            m = m / np.sqrt(squares[good])[:, None]
        return np.flatnonzero(fits)[good], m

    def distances(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of every row to every centroid, and how far each may be off."""
        m = m - self.middle
        squares = np.square(m).sum(axis=1)
        apart = squares[:, None] + self.squares[None, :] - 2 * (m @ self.points.T)
        reach = np.abs(self.middle).max(initial=0)
        error = 8 * (self.width + 8) * np.finfo(float).eps * (squares[:, None] + self.squares[None, :] + reach * np.sqrt(squares[:, None] + 1))
        found = np.sqrt(np.maximum(apart, 0))
        return found, np.sqrt(error)


def _sums(centroids: Centroids, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(centroids.points), np.zeros(len(centroids.points), np.int64)
        for batch in batches:
            _, m = centroids.usable(batch.column(column))
            for s in range(0, len(m), _ROWS_AT_ONCE):
                part = m[s : s + _ROWS_AT_ONCE]
                cell = centroids.distances(part)[0].argmin(axis=1)
                np.add.at(total, cell, part)
                count += np.bincount(cell, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(total[some].tolist(), pa.list_(pa.float64())), pa.array(count[some])], names=["cell", "total", "n"]
        )

    return run


def _added(part: pa.Table) -> pa.Table:
    """The sum of the partial sums of one cell, one a task."""
    n = pa.compute.sum(part["n"]).as_py()
    mean = matrix(part["total"].combine_chunks()).sum(axis=0) / n
    return pa.table({"cell": part["cell"].slice(0, 1), "mean": pa.array([mean.tolist()], pa.list_(pa.float64()))})


def train(vectors: DataFrame, column: str, cells: int, metric: str = "cosine", rounds: int = ROUNDS) -> Centroids | None:
    """Centroids for ``vectors``, at most ``cells`` of them; None where no vector has a length.

    They start as the sampled vectors with the smallest hashes and move to the mean of their vectors in
    each round; tasks add up their own rows. The sample holds ``SAMPLE_PER_CELL`` vectors a cell
    or ``SAMPLE_BYTES``, whichever is less; only the training is sampled. Vectors of the
    most frequent length count, of equals the greater.
    """
    cells = min(cells, MAX_CELLS)
    lengths = vectors.groupBy(F.size(column).alias("dim")).count().filter("dim > 0")
    most = lengths.orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None:
        return None
    dim, count = most["dim"], most["count"]
    wanted = max(cells, min(cells * SAMPLE_PER_CELL, SAMPLE_BYTES // (8 * dim)))
    rows = vectors.filter(F.size(column) == dim).select(F.col(column).cast("array<double>").alias("v"))
    if count > wanted:
        grain = 1 << 30
        rows = rows.filter(F.pmod(F.xxhash64("v", F.lit("train")), F.lit(grain)) < int(grain * wanted / count) + 1)
    first = rows.select("v").distinct().orderBy(F.xxhash64("v")).limit(2 * cells).toArrow()
    points = matrix(first["v"].combine_chunks()) if len(first) else np.empty((0, dim))
    start = Centroids(np.zeros((1, dim)), metric)
    _, points = start.usable(pa.array(points.tolist(), pa.list_(pa.float64())))
    if not len(points):
        return None
    centroids = Centroids(points[:cells], metric)
    for _ in range(rounds if count > len(points) else 0):
        sums = rows.mapInArrow(_sums(centroids, 0), "cell long, total array<double>, n long")
        moved = sums.groupBy("cell").applyInArrow(_added, "cell long, mean array<double>").toArrow()
        if not len(moved):
            break
        centroids = Centroids(matrix(moved["mean"].combine_chunks()), metric)
    return centroids


def assigned(rows: DataFrame, column: str, centroids: Centroids) -> DataFrame:
    """``rows`` with ``cell`` and ``reach``, the greatest possible distance from its centroid.

    A vector that has no score under the metric, or another length, has no cell.
    """
    from pyspark.sql import types as T

    place = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, reach = np.full(len(batch), -1, np.int64), np.zeros(len(batch))
            at, m = centroids.usable(batch.column(place))
            for s in range(0, len(m), _ROWS_AT_ONCE):
                found, error = centroids.distances(m[s : s + _ROWS_AT_ONCE])
                own = found.argmin(axis=1)
                cell[at[s : s + _ROWS_AT_ONCE]] = own
                line = np.arange(len(own))
                reach[at[s : s + _ROWS_AT_ONCE]] = found[line, own] + error[line, own]
            known = pa.array(cell >= 0)
            columns = [pa.compute.if_else(known, pa.array(c), pa.scalar(None, t)) for c, t in ((cell, pa.int64()), (reach, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "cell", "reach"])

    extra = [T.StructField("cell", T.LongType()), T.StructField("reach", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *extra]))
