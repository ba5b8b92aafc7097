"""Approximate search in an inverted file: stored by cell, few cells read, exact scores (O-48)."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitrine.functions.vectors import matrix
from vitrine.operators.cells import MAX_CELLS, Centroids, assigned, train
from vitrine.operators.topk import ranked, search_visits, topk, topk_batch
from vitrine.session import stage

# Vectors a cell should hold; recall to reach, and vectors that are searched exactly to find out how.
CELL_VECTORS = 4096
RECALL, MEASURED, BEST = 0.95, 64, 10


@dataclass
class InvertedFile:
    """A stored index: ``cells`` is partitioned by ``cell``, ``centroids`` are few."""

    rows: DataFrame
    centroids: Centroids
    vec_col: str
    id_col: str
    probes: int


def build(
    index: DataFrame, path: str, cells: int | None = None, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding",
    recall: float = RECALL,
) -> InvertedFile:
    """Write every row of ``index`` to ``path``, in a folder for its cell, and open it.

    Centroids are trained on a bounded sample (:func:`train`), rows are all assigned. A cell that holds
    a large share of the rows is written by several tasks. Rows without a score under the
    metric go to cell -1, which no search reads. How many cells a search reads is measured:
    ``MEASURED`` rows are searched exactly, and the fewest cells that hold the share ``recall`` of
    their ``BEST`` results are stored as the file's ``probes``.
    """
    n = index.count()
    cells = cells or min(MAX_CELLS, max(16, n // CELL_VECTORS))
    centroids = train(index, vec_col, cells, metric) or Centroids(np.zeros((1, 1)), metric)
    placed = assigned(index, vec_col, centroids).drop("reach").withColumn("cell", F.coalesce("cell", F.lit(-1).cast("long")))
    placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/cells")
    rows = index.sparkSession.read.schema(placed.schema).parquet(f"{path}/cells")
    probes = _needed(InvertedFile(rows, centroids, vec_col, id_col, len(centroids.points)), recall)
    points = [(i, metric, probes, placed.schema.json(), [float(x) for x in p]) for i, p in enumerate(centroids.points + centroids.middle)]
    schema = "cell long, metric string, probes int, columns string, point array<double>"
    index.sparkSession.createDataFrame(points, schema).coalesce(1).write.parquet(f"{path}/centroids")
    return open_file(index.sparkSession, path, id_col, vec_col)


def open_file(spark: SparkSession, path: str, id_col: str = "id", vec_col: str = "embedding") -> InvertedFile:
    points = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow()
    centroids = Centroids(matrix(points["point"].combine_chunks()), points["metric"][0].as_py())
    columns = StructType.fromJson(json.loads(points["columns"][0].as_py()))
    return InvertedFile(spark.read.schema(columns).parquet(f"{path}/cells"), centroids, vec_col, id_col, points["probes"][0].as_py())


def _needed(file: InvertedFile, recall: float) -> int:
    """Cells to read for ``recall`` over a bounded sample of the file's own rows."""
    rows = file.rows.filter("cell >= 0").select(F.col(file.id_col).alias("id"), F.col(file.vec_col).cast("array<double>").alias("embedding"), "cell")
    asked = stage(rows.orderBy(F.xxhash64("id", F.lit("measure"))).limit(MEASURED).selectExpr("id AS query_id", "embedding AS query"), "measured")
    best = topk_batch(rows, asked, BEST, file.centroids.metric).join(rows.select("id", "cell"), "id").select("query_id", "cell").toArrow()
    sample = asked.toArrow()
    if not len(best):
        return 1
    at, m = file.centroids.usable(sample["query"].combine_chunks())
    order = np.argsort(file.centroids.distances(m)[0], axis=1, kind="stable")
    turn = np.argsort(order, axis=1)
    line = {sample["query_id"][int(i)].as_py(): n for n, i in enumerate(at)}
    turns = np.sort([turn[line[q], c] for q, c in zip(best["query_id"].to_pylist(), best["cell"].to_pylist())])
    return int(turns[min(len(turns) - 1, int(np.ceil(recall * len(turns))) - 1)]) + 1


def search(file: InvertedFile, query: Sequence[float], k: int = 10, probes: int | None = None, conditions: Mapping | None = None) -> DataFrame:
    """O-48: ``(id, score)`` of the ``k`` nearest in the nearest ``probes`` cells, or the file's own number.

    The cells become a partition filter, so other folders are not listed or read.
    """
    at, m = file.centroids.usable(pa.array([list(map(float, query))], pa.list_(pa.float64())))
    nearest = file.centroids.distances(m)[0][0].argsort(kind="stable")[: probes or file.probes].tolist() if len(at) else []
    rows = file.rows.filter(F.col("cell").isin(nearest)).drop("cell")
    return topk(rows, query, k, file.centroids.metric, conditions, file.id_col, file.vec_col)


def search_batch(file: InvertedFile, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """O-48 for many queries ``(query_id, query)``: ``(query_id, rank, id, score)``.

    Each query visits its nearest cells; rows are read once, whatever the number of queries.
    """
    centroids, n = file.centroids, min(len(file.centroids.points), probes or file.probes)

    def visits(batches):
        for batch in batches:
            at, m = centroids.usable(batch.column(1))
            nearest = np.argsort(centroids.distances(m)[0], axis=1, kind="stable")[:, :n] if len(m) else np.empty((0, n), np.int64)
            picked = batch.take(pa.array(np.repeat(at, nearest.shape[1])))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(nearest.ravel(), pa.int64())], names=["query_id", "query", "cell"])

    asked = queries.select("query_id", F.col("query").cast("array<double>").alias("query")).filter("query_id IS NOT NULL")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, query array<double>, cell long"
    visited = stage(asked.mapInArrow(visits, schema), "visits")
    rows = file.rows.filter("cell >= 0").select(F.col(file.id_col).alias("id"), F.col(file.vec_col).alias("embedding"), F.col("cell").cast("long").alias("cell"))
    return ranked(search_visits(rows, visited, k, centroids.metric), k, centroids.metric)
