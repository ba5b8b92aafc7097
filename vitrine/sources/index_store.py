"""The vector index as a Parquet table of a base and deltas (O-07, O-42, O-43).

Layout below ``root/name``::

    properties/          one JSON row: dimension, metric, promoted filter fields
    data/<folder>/       entries sorted by id
    commits/N.json       the folders that make up generation N, oldest first

An upsert writes only its own entries, as one more delta, and becomes visible with its commit;
readers never see a half-written state and no path is read and overwritten at once. Entries of
one id are told apart by ``(epoch, order_no, generation)``, the greatest of which counts. A plain
upsert begins a new epoch and so replaces whatever is there; a stream's batches stay in the
current one, so a replayed batch cannot replace a newer entry. Several deltas are merged into
one, and into the base once they have grown to a share of it. Files are sorted by id in ranges,
so entries of a few ids are found by the statistics of row groups, and filter fields named at
creation are columns of their own, which reach the scan.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions.dynamic import kind
from vitrine.operators.keyed import keep_last
from vitrine.session import delete_path, list_children, path_exists
from vitrine.sources.commits import CommitLog

# Deltas that are merged into one, and the share of the base above which they join it.
MAX_DELTAS = 16
BASE_SHARE = 0.25
# Ids whose entries are looked up by value; more are joined.
FEW_IDS = 1_000
# Changed ids that are sent to every task of a read; more are joined by a shuffle.
FEW_CHANGES = 1_000_000

_ENTRY = "id string, embedding array<double>, metadata map<string,variant>"
_VERSION = ["epoch", "order_no", "generation"]
_KINDS = {"string": "string", "double": "number", "boolean": "boolean"}


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    dim: int
    metric: str
    filters: tuple[tuple[str, str], ...] = ()

    @property
    def _log(self) -> CommitLog:
        return CommitLog(self.spark, f"{self.path}/commits")

    @property
    def columns(self) -> list[str]:
        return ["id", "embedding", "metadata", *(name for name, _ in self.filters)]

    @property
    def _schema(self) -> str:
        promoted = "".join(f", `{name}` {kind}" for name, kind in self.filters)
        return f"{_ENTRY}{promoted}, epoch long, order_no long, generation long"

    def generation(self) -> int:
        """Latest complete commit, 0 for an empty index: one listing, whatever came before."""
        return self._log.latest()[0]

    def _folder(self, placed: dict) -> DataFrame:
        """Entries of one folder; those of an upsert take its epoch and generation."""
        rows = self.spark.read.schema(self._schema).parquet(f"{self.path}/data/{placed['folder']}")
        return rows.withColumns(
            {name: F.coalesce(name, F.lit(placed[name]).cast("long")) for name in ("epoch", "generation")}
        )

    def _parts(self, content: dict) -> tuple[DataFrame | None, DataFrame | None]:
        """The base, unique by id, and all deltas."""
        folders = [self._folder(placed) for placed in content.get("folders", [])]
        base = folders.pop(0) if content.get("folders") and content["folders"][0]["base"] else None
        return base, reduce(DataFrame.unionByName, folders) if folders else None

    def _current(self, content: dict) -> DataFrame:
        """One row per id with its version columns."""
        base, deltas = self._parts(content)
        if base is None and deltas is None:
            return self.spark.createDataFrame([], self._schema)
        if deltas is None:
            return base
        if base is None:
            return keep_last(deltas, "id", *_VERSION)
        changed = deltas.select("id").distinct()
        if sum(p["rows"] for p in content["folders"] if not p["base"]) <= FEW_CHANGES:
            changed = F.broadcast(changed)
        contested = base.join(changed, "id", "left_semi").unionByName(deltas)
        return base.join(changed, "id", "left_anti").unionByName(keep_last(contested, "id", *_VERSION))

    def read(self) -> DataFrame:
        """O-07: current entries ``(id, embedding, metadata, promoted fields)``, one row per id."""
        return self._current(self._log.latest()[1]).select(*self.columns)

    def entries_of(self, ids: DataFrame) -> DataFrame:
        """Entries of a few ids, such as a top-k result; row groups without them are skipped."""
        wanted = [r["id"] for r in ids.select("id").distinct().limit(FEW_IDS + 1).collect()]
        if len(wanted) > FEW_IDS:
            return self.read().join(ids.select("id").distinct(), "id", "left_semi")
        return self.read().filter(F.col("id").isin(wanted))

    def last_batch(self, stream: str) -> int | None:
        """Latest batch of a stream that is in the index, None when there is none."""
        return self._log.latest()[1].get("streams", {}).get(stream)

    def _promoted(self) -> dict:
        entry = {name: F.try_element_at("metadata", F.lit(name)) for name, _ in self.filters}
        return {
            name: F.when(kind(entry[name]) == _KINDS[of], F.try_variant_get(entry[name], "$", of))
            for name, of in self.filters
        }

    def _write(self, entries: DataFrame, label: str) -> tuple[str, int]:
        folder = f"{label}-{uuid.uuid4().hex}"
        path = f"{self.path}/data/{folder}"
        entries.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
        return folder, self.spark.read.schema(self._schema).parquet(path).count()

    def upsert(
        self, updates: DataFrame, order: str, stream: str | None = None, batch_id: int | None = None
    ) -> int:
        """O-43: insert or replace entries, the last per id by ``order``; returns the generation.

        Rows with a null order lose to others. Vectors of another dimension are refused before
        anything becomes visible. With ``stream`` and ``batch_id`` a batch already in the index
        changes nothing, and no entry with a greater order (as a whole number, of one kind in
        all streams of an index) is replaced.
        """
        if stream is not None and (last := self.last_batch(stream)) is not None and last >= batch_id:
            return self.generation()
        dim_ok = F.when(F.size("embedding") == self.dim, F.col("embedding")).otherwise(
            F.raise_error(F.concat(F.lit(f"index holds {self.dim} dimensions, not those of "), "id"))
        )
        entries = updates.select(
            F.col("id").cast("string").alias("id"),
            dim_ok.cast("array<double>").alias("embedding"),
            F.col("metadata"),
            F.col(order).cast("long").alias("order_no") if stream is not None else F.col(order).alias("_order"),
        )
        # rows that tie in their order, such as a record delivered twice, leave one
        latest = keep_last(entries, "id", "order_no" if stream is not None else "_order").dropDuplicates(["id"])
        numbered = latest if stream is not None else latest.withColumn("order_no", F.lit(None).cast("long"))
        null = F.lit(None).cast("long")
        folder, rows = self._write(
            numbered.withColumns({**self._promoted(), "epoch": null, "generation": null}).select(
                *self.columns, *_VERSION
            ),
            "delta",
        )
        if not rows and stream is None:
            return self.generation()

        def change(number: int, content: dict) -> dict | None:
            streams = content.get("streams", {})
            if stream is not None and streams.get(stream, -1) >= batch_id:
                return None
            epoch = content.get("epoch", 0) if stream is not None else number
            placed = {"folder": folder, "base": False, "rows": rows, "epoch": epoch, "generation": number}
            return {
                "epoch": epoch,
                "streams": streams if stream is None else {**streams, stream: batch_id},
                "folders": [*content.get("folders", []), *([placed] if rows else [])],
            }

        self._log.append(change)
        self._merge_if_due()
        return self.generation()

    def _merge_if_due(self) -> None:
        folders = self._log.latest()[1].get("folders", [])
        deltas = [p for p in folders if not p["base"]]
        if len(deltas) > MAX_DELTAS:
            base_rows = sum(p["rows"] for p in folders if p["base"])
            self.compact(full=sum(p["rows"] for p in deltas) >= BASE_SHARE * base_rows)

    def compact(self, full: bool = True) -> int:
        """Merge the deltas into one, or with ``full`` into the base; returns the generation.

        Upserts committed meanwhile stay as deltas on top.
        """
        before = self._log.latest()[1]
        merged = [p for p in before.get("folders", []) if full or not p["base"]]
        if len(merged) <= 1 and all(p["base"] for p in merged):
            return self.generation()
        folder, rows = self._write(self._current({**before, "folders": merged}).select(*self.columns, *_VERSION), "base" if full else "delta")
        gone = {p["folder"] for p in merged}
        placed = {"folder": folder, "base": full, "rows": rows, "epoch": None, "generation": None}

        def change(_: int, content: dict) -> dict | None:
            names = [p["folder"] for p in content["folders"]]
            if not gone <= set(names):
                return None  # another writer has merged them
            kept = [p for p in content["folders"] if p["folder"] not in gone]
            at = sum(1 for p in kept if p["base"])
            return {**content, "folders": [*kept[:at], placed, *kept[at:]]}

        return self._log.append(change)

    def expire(self) -> None:
        """Delete data folders that no commit still on record uses; no upsert may be running."""
        log = self._log
        live = {p["folder"] for n in log._numbers() for p in (log._read(n) or {}).get("folders", [])}
        newest = {p["folder"] for p in log.latest()[1].get("folders", [])}
        for number in log._numbers()[:-1]:
            delete_path(self.spark, f"{self.path}/commits/{number}.json")
        for name in list_children(self.spark, f"{self.path}/data"):
            if name not in newest and (name in live or name.startswith(("base-", "delta-"))):
                delete_path(self.spark, f"{self.path}/data/{name}")


def open_index(spark: SparkSession, root: str, name: str) -> VectorIndex:
    """O-07: an existing index by name."""
    path = f"{root.rstrip('/')}/{name}"
    if not path_exists(spark, f"{path}/properties/_SUCCESS"):
        raise FileNotFoundError(f"no index {name!r} below {root}")
    row = spark.read.schema("dim int, metric string, filters string").json(f"{path}/properties").first()
    filters = tuple(tuple(pair) for pair in json.loads(row["filters"] or "[]"))
    return VectorIndex(spark, path, row["dim"], row["metric"], filters)


def ensure_index(
    spark: SparkSession,
    root: str,
    name: str,
    dim: int,
    metric: str = "cosine",
    filters: dict[str, str] | None = None,
) -> VectorIndex:
    """O-42: open the index, creating it when absent; other settings than stored raise.

    ``filters`` names metadata fields, with ``string``, ``double`` or ``boolean``, that become
    columns, so that conditions on them are pushed into the scan. None takes those stored.
    """
    path = f"{root.rstrip('/')}/{name}"
    wanted = tuple((filters or {}).items())
    if not path_exists(spark, f"{path}/properties/_SUCCESS"):
        if metric not in ("cosine", "euclidean"):
            raise ValueError(f"unknown metric {metric!r}")
        reserved = {"id", "embedding", "metadata", *_VERSION}
        for field, of in wanted:
            if of not in _KINDS or field.lower() in reserved:
                raise ValueError(f"cannot promote {field!r} as {of!r}")
        properties = spark.createDataFrame(
            [(dim, metric, json.dumps(wanted))], "dim int, metric string, filters string"
        )
        properties.coalesce(1).write.mode("overwrite").json(f"{path}/properties")
    index = open_index(spark, root, name)
    if (index.dim, index.metric) != (dim, metric):
        raise ValueError(
            f"index {name!r} has dimension {index.dim} and metric {index.metric}, "
            f"not {dim} and {metric}"
        )
    if filters is not None and index.filters != wanted:
        raise ValueError(f"index {name!r} promotes {dict(index.filters)}, not {filters}")
    return index
