"""Streaming upsert and near-duplicate removal with stored state (O-54, O-55)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.operators.joins import lookup
from vitrine.operators.neardup import near_dup_winners
from vitrine.session import delete_path, list_children, scratch_scope, stage
from vitrine.sources.commits import KEPT_COMMITS, CommitLog
from vitrine.sources.index_store import VectorIndex
from vitrine.streaming.ingest import start_batches

# Parts of a bucket state by hash, and folders of it that are merged into one.
STATE_PARTS = 64
MAX_FOLDERS = 24


def stream_id(batch: DataFrame) -> str:
    """Identity of the running stream; it lives in the checkpoint and survives restarts."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def stream_upsert(stream: DataFrame, index: VectorIndex, order: str, checkpoint: str) -> None:
    """O-54: upsert every micro-batch; one that the index already holds changes nothing.

    Batches are known by stream and number, so several streams may write to one index. Where
    the checkpoint is lost, the input comes again as another stream, and as an entry is
    replaced only by one with a greater ``order``, it leaves the index as it was.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        index.upsert(batch, order, stream_id(batch), batch_id)

    start_batches(stream, checkpoint, apply).awaitTermination()


class BucketState:
    """Buckets of the rows that streams have kept, written by batch and read by hash part.

    A batch is one folder with the order and buckets of its kept rows; the commit that names it
    makes it count. Older folders are merged, but the last of each stream stays, so that a
    batch that comes again finds what it kept.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/commits")

    def _rows(self, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        schema = "order_no long, bucket long, folder string, part int"
        paths = [f"{self.path}/data/folder={name}" for name in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def kept(self, stream: str, batch_id: int) -> DataFrame | None:
        """Orders a batch kept when it ran before; None for a new one."""
        place = self.log.latest()[1].get("last", {}).get(stream)
        if place is None or place["batch"] != batch_id:
            if place is not None and place["batch"] > batch_id:
                raise ValueError(f"batch {batch_id} of stream {stream} is older than its last, {place['batch']}")
            return None
        return self._rows([place["folder"]]).select("order_no").distinct()

    def seen(self, buckets: DataFrame) -> DataFrame | None:
        """Stored buckets in the parts that ``buckets`` fall into."""
        stored = self._rows(self.log.latest()[1].get("folders", []))
        if stored is None:
            return None
        parts = [r["part"] for r in buckets.select(_part("bucket")).distinct().collect()]
        return stored.filter(F.col("part").isin(parts)).select("bucket").distinct()

    def store(self, rows: DataFrame, stream: str, batch_id: int) -> None:
        """Record the ``order_no, bucket`` rows a batch has kept."""
        folder = f"batch-{uuid.uuid4().hex}"
        self._write(rows, folder)

        def change(_: int, content: dict) -> dict:
            last = {**content.get("last", {}), stream: {"batch": batch_id, "folder": folder}}
            return {**content, "last": last, "folders": [*content.get("folders", []), folder]}

        self.log.append(change)
        if len(self.log.latest()[1]["folders"]) > MAX_FOLDERS + len(self.log.latest()[1]["last"]):
            self.compact()

    def _write(self, rows: DataFrame, folder: str) -> None:
        placed = rows.withColumn("part", _part("bucket"))
        placed.repartition("part").write.partitionBy("part").parquet(f"{self.path}/data/folder={folder}")

    def compact(self) -> None:
        """Merge all folders but the last of each stream."""
        content = self.log.latest()[1]
        held = {place["folder"] for place in content.get("last", {}).values()}
        merged = [name for name in content.get("folders", []) if name not in held]
        if len(merged) < 2:
            return
        folder = f"merged-{uuid.uuid4().hex}"
        rows = self._rows(merged).groupBy("bucket").agg(F.min("order_no").alias("order_no"))
        self._write(rows.select("order_no", "bucket"), folder)

        def change(_: int, now: dict) -> dict | None:
            if not set(merged) <= set(now["folders"]):
                return None
            return {**now, "folders": [folder, *(n for n in now["folders"] if n not in merged)]}

        self.log.append(change)

    def expire(self) -> None:
        """Delete folders no commit on record names; no stream may be running."""
        numbers = self.log._numbers()[-KEPT_COMMITS:]
        live = {name for n in numbers for name in (self.log._read(n) or {}).get("folders", [])}
        for name in list_children(self.spark, f"{self.path}/data"):
            if name.removeprefix("folder=") not in live:
                delete_path(self.spark, f"{self.path}/data/{name}")


def _part(bucket: str) -> Column:
    return F.pmod(F.xxhash64(bucket), F.lit(STATE_PARTS)).cast("int").alias("part")


def drop_near_dups_in_batch(
    batch: DataFrame, order: str, buckets: Column, state: str, batch_id: int, stream: str = ""
) -> DataFrame:
    """One step of O-55: rows of a batch that collide with nothing kept so far.

    Rows sharing a bucket with a row kept by an earlier batch of any stream go first; the
    greedy walk then runs within the batch, and the buckets of its survivors are stored. A batch
    that comes again keeps what it kept before.
    """
    spark = batch.sparkSession
    stored = BucketState(spark, state)
    signed = stage(batch.withColumn("_buckets", buckets), "signed")
    before = stored.kept(stream, batch_id)
    if before is not None:
        return signed.join(before.withColumnRenamed("order_no", order), order, "left_semi").drop("_buckets")
    fresh = signed
    members = signed.select(order, F.explode("_buckets").alias("bucket"))
    held = stored.seen(members)
    if held is not None:
        seen = lookup(members, held, "bucket", unique=True).filter("found").select(order).distinct()
        fresh = signed.join(seen, order, "left_anti")
    kept = stage(signed.join(near_dup_winners(fresh, order, F.col("_buckets")), order, "left_semi"), "kept")
    # a row without buckets is kept too, and remembered by its order
    rows = kept.select(F.col(order).cast("long").alias("order_no"), F.explode_outer("_buckets").alias("bucket"))
    stored.store(rows.distinct(), stream, batch_id)
    return kept.drop("_buckets")


def stream_drop_near_dups(
    stream: DataFrame, order: str, buckets: Column, state: str, out: str, checkpoint: str
) -> None:
    """O-55: write the rows of a stream that survive the greedy near-duplicate drop.

    Equals the batch operator on the whole input when batches arrive in ``order``. Several
    streams may share one state and one output, one after the other; each keeps its own folders.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        name = stream_id(batch)
        with scratch_scope(batch.sparkSession):
            kept = drop_near_dups_in_batch(batch, order, buckets, state, batch_id, name)
            kept.write.mode("overwrite").parquet(f"{out}/stream={name}/batch={batch_id}")

    start_batches(stream, checkpoint, apply).awaitTermination()
