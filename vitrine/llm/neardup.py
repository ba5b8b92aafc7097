"""Near-duplicates: MinHash bands, odd sketches of the samples, and exact links.

A text's set holds the hashes of its distinct runs of five words. Texts with equal sets form a
class, and only one text of each class goes on. Its MinHash samples are cut into bands; texts
that share a band are candidates, and at the threshold a pair shares none with a chance below
one in a hundred million. The samples are also folded into an odd sketch, a bitmap that keeps the
parity of the samples falling on each bit: the set bits of two sketches' XOR tell how many
samples differ, so a few machine words decide whether a candidate pair is worth an exact look.

No bucket is expanded into its pairs. Members are compared with their bucket's smallest one by
the native XOR count; only in buckets where that fails for some are sketches compared block by
block, which returns a spanning forest. The forests' components, tight candidate clusters, then
get each text's whole set once, and exact links are counted there, block by block again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.components import components
from vitrine.llm.rolling import _WORDS, SPACED, chunks, find_words, mix, raw_texts, span_hashes
from vitrine.llm.tables import few_rows, fresh
from vitrine.session import stage

SHINGLE = 5
#: The least similarity, as a fraction of integers.
SIMILARITY = (80, 100)
ROWS = 4
#: Chance that a pair at the threshold shares no band.
MISS = 1e-8
SKETCH_BITS = 512
#: Standard deviations of the sample that the sketch test allows for.
SLACK = 5.5
#: Texts, and shingles, of one part of a bucket or cluster; a task holds two parts.
PART_TEXTS = 512
PART_SHINGLES = 400_000


def band_count(similarity: tuple[int, int], rows: int = ROWS) -> int:
    """Bands that leave a pair at the threshold unseen with a chance of at most ``MISS``."""
    return math.ceil(math.log(MISS) / math.log1p(-((similarity[0] / similarity[1]) ** rows)))


def sketch_limit(similarity: tuple[int, int], samples: int) -> int:
    """Bits in which the sketches of a pair at the threshold may differ."""
    s = similarity[0] / similarity[1]
    apart = 2 * samples * (1 - s) + SLACK * 2 * math.sqrt(samples * s * (1 - s))
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * apart / SKETCH_BITS)))


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    words = find_words(texts, SPACED, lower=True)
    at, value = words.windows(SHINGLE)
    bounds = np.searchsorted(at, words.first)
    counts = words.counts
    whole = words.whole()
    sets = []
    for i in range(len(texts)):
        if counts[i] >= SHINGLE:
            own = np.sort(value[bounds[i] : bounds[i + 1]])
            sets.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            sets.append(whole[i : i + (counts[i] > 0)])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), first


def _seeds(samples: int) -> tuple[np.ndarray, np.ndarray]:
    drawn = mix(np.arange(1, 2 * samples + 1, dtype=np.uint64))
    return drawn[:samples], drawn[samples:] | np.uint64(1)


def _signatures(bands: int):
    samples = bands * ROWS
    keys, factors = _seeds(samples)
    turns = (np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]
    odds = _seeds(ROWS)[1][None, :, None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(1))
            for s, e in chunks(texts):
                values, first = shingle_sets(texts[s:e])
                size = np.diff(first)
                some = np.flatnonzero(size)
                least = np.zeros((samples, len(some)), np.uint64)
                work = np.empty_like(values)
                for i in range(samples if len(some) else 0):
                    np.bitwise_xor(values, keys[i], out=work)
                    np.multiply(work, factors[i], out=work)
                    np.minimum.reduceat(work, first[some], out=least[i])
                marks = mix(least + turns)
                grouped = (marks.reshape(bands, ROWS, -1) * odds).sum(axis=1, dtype=np.uint64)
                grouped = mix(grouped + np.arange(bands, dtype=np.uint64)[:, None]).T
                bits = (marks % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(len(some)) * SKETCH_BITS
                parity = np.bincount(bits.ravel(), minlength=len(some) * SKETCH_BITS) & 1
                sketch = np.packbits(parity.astype(np.uint8)).view(np.int64)
                set_key = [span_hashes(values, w, first[:-1], first[1:]).view(np.int64) for w in _WORDS]
                present = (size > 0).astype(np.int32)

                def lists(flat: np.ndarray, each: int) -> pa.Array:
                    offsets = np.r_[0, np.cumsum(present * each)].astype(np.int32)
                    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), batch.column(2).slice(s, e - s), pa.array(size), pa.array(set_key[0]), pa.array(set_key[1]),
                     lists(np.ascontiguousarray(grouped).ravel().view(np.int64), bands), lists(sketch, SKETCH_BITS // 64)],
                    names=["doc_id", "mark", "n_shingles", "key1", "key2", "bands", "sketch"],
                )

    return run


def signatures(docs: DataFrame, bands: int) -> DataFrame:
    """Text hash, set size, set hash, band keys and odd sketch of every text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).mapInArrow(
        _signatures(bands),
        "doc_id long, mark long, n_shingles long, key1 long, key2 long, bands array<long>, sketch array<long>",
    )


def _apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ."""
    return reduce(lambda x, y: x + y, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)])


def _roots(linked: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked node to the smallest node of its component."""
    free = np.ones(len(nodes), bool)
    a, b = [], []
    for i in range(len(nodes)):
        if not free[i]:
            continue
        inside = np.zeros(len(nodes), bool)
        edge = np.array([i])
        inside[i] = True
        while len(edge):
            new = linked[edge].any(axis=0) & ~inside
            inside |= new
            edge = np.flatnonzero(new)
        free &= ~inside
        own = nodes[inside]
        if (root := own.min()) != own.max():
            own = own[own != root]
            a.append(own)
            b.append(np.full(len(own), root))
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _edge_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _sketch_forest(limit: int):
    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        flat = table["sketch"].combine_chunks().flatten().to_numpy()
        sketch = flat.view(np.uint64).reshape(len(nodes), -1)
        linked = np.zeros((len(nodes), len(nodes)), bool)
        for s in range(0, len(nodes), 128):
            apart = np.zeros((min(128, len(nodes) - s), len(nodes)), np.int16)
            for w in range(sketch.shape[1]):
                apart += np.bitwise_count(sketch[s : s + 128, w, None] ^ sketch[None, :, w])
            linked[s : s + 128] = apart <= limit
        return _edge_table(*_roots(linked, nodes))

    return run


def _exact_links(similarity: tuple[int, int]):
    num, den = similarity

    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in table["hashes"].to_pylist()]
        size = np.array([len(s) for s in sets], np.int64)
        if len(nodes) == 2:
            both = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
            both[1, 0] = both[0, 1]
        else:
            value, owner = np.concatenate(sets), np.repeat(np.arange(len(nodes)), size)
            order = np.argsort(value)
            value, owner = value[order], owner[order]
            same = value[1:] == value[:-1]
            shared = np.r_[same, False] | np.r_[False, same]
            value, owner = value[shared], owner[shared]
            column = np.cumsum(np.r_[True, value[1:] != value[:-1]]) - 1 if len(value) else value
            both = np.zeros((len(nodes), len(nodes)), np.float32)
            width = 4096
            cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + width + 1, width))
            for i, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])):
                part = np.zeros((len(nodes), width), np.float32)
                part[owner[s:e], (column[s:e] - np.uint64(i * width)).astype(np.int64) if column.dtype == np.uint64 else column[s:e] - i * width] = 1
                both += part @ part.T
            both = both.astype(np.int64)
        union = size[:, None] + size[None, :] - both
        return _edge_table(*_roots(den * both >= num * union, nodes))

    return run


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = raw_texts(batch.column(batch.num_columns - 1))
        for s, e in chunks(texts):
            values, first = shingle_sets(texts[s:e])
            hashes = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
            kept = batch.slice(s, e - s).columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hashes, pa.binary())], names=[*batch.schema.names[:-1], "hashes"])


def _paired_parts(df: DataFrame, key: str, parts: str) -> DataFrame:
    """Each row once for every pair of parts that its own part belongs to."""
    own = F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    return (
        df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(parts) - 1)))
        .withColumn("_low", F.least("_own", "_other")).withColumn("_high", F.greatest("_own", "_other"))
        .drop("_own", "_other", parts)
    )


def _candidate_clusters(reps: DataFrame, bands: int, similarity: tuple[int, int]) -> DataFrame:
    """Components of the pairs that share a band and have near sketches."""
    limit = sketch_limit(similarity, bands * ROWS)
    buckets = reps.select("node", F.explode("bands").alias("band"))
    shared = stage(
        buckets.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last"), F.count("*").alias("n"))
        .filter("head <> last").drop("last"),
        "shared-bands",
    )
    members = stage(buckets.join(few_rows(shared), "band"), "bucket-members")
    pairs = members.filter("node <> head").select("node", "head").distinct()
    sketches = reps.select("node", "sketch")
    judged = stage(
        pairs.join(sketches, "node").join(sketches.toDF("head", "head_sketch"), "head")
        .select("node", "head", (_apart("sketch", "head_sketch") <= limit).alias("near")),
        "judged",
    )
    far = judged.filter("NOT near").select("node", "head").distinct()
    open_bands = members.join(far, ["node", "head"], "left_semi").select("band").distinct()
    parts = F.ceil(F.col("n") / PART_TEXTS).cast("int")
    rest = members.join(open_bands, "band", "left_semi").select("band", "node", parts.alias("parts")).join(sketches, "node")
    forest = _paired_parts(rest, "band", "parts").groupBy("band", "_low", "_high").applyInArrow(_sketch_forest(limit), "a long, b long")
    near = judged.filter("near").select(F.col("node").alias("a"), F.col("head").alias("b"))
    return components(near.union(forest)).withColumnRenamed("component", "cluster")


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs``.

    Words are runs of anything but space and the controls from tab to carriage return, A-Z
    lower-cased. The set holds the distinct runs of five words, or the whole sequence of fewer;
    a null or empty text has an empty set and is linked with nothing. Texts are linked if
    the intersection is at least ``similarity`` of the union, confirmed on whole sets.
    ``component_id`` is the smallest ``doc_id`` that links reach, ``kept`` marks it. Rows that
    share a ``doc_id`` are judged by their texts; where such an id is the smallest of two
    groups, these count as one. A row without an id takes no part: its component is null and it
    is kept.
    """
    return _judged(docs, similarity).drop("mark")


def _judged(docs: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text, ``mark``."""
    bands = band_count(similarity)
    signed = stage(signatures(docs, bands), "signatures")
    classes = stage(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key1", "key2").agg(F.min("doc_id").alias("node")), "classes"
    )
    reps = stage(
        signed.join(classes.withColumnRenamed("node", "doc_id"), ["key1", "key2", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("node"), "n_shingles", "bands", "sketch"),
        "representatives",
    )
    clusters = _candidate_clusters(reps, bands, similarity)
    sizes = (
        clusters.join(reps.select("node", "n_shingles"), "node").groupBy("cluster")
        .agg(F.greatest(F.ceil(F.count("*") / PART_TEXTS), F.ceil(F.sum("n_shingles") / PART_SHINGLES)).cast("int").alias("parts"))
    )
    placed = stage(clusters.join(sizes, "cluster"), "clusters")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    wanted = texts.join(few_rows(placed.select("node").distinct()), "node", "left_semi").join(placed, "node").select("node", "cluster", "parts", "text")
    sets = wanted.mapInArrow(_with_sets, "node long, cluster long, parts int, hashes binary")
    links = _paired_parts(sets, "cluster", "parts").groupBy("cluster", "_low", "_high").applyInArrow(_exact_links(similarity), "a long, b long")
    linked = components(links)
    found = stage(
        classes.join(linked, "node", "left").select("key1", "key2", F.coalesce("component", "node").alias("component_id")), "class-components"
    )
    named = signed.select("doc_id", "mark", "n_shingles", "key1", "key2").join(found, ["key1", "key2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return named.select("doc_id", "mark", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents of ``docs`` that are the smallest of their group, with all columns.

    A row goes by its id and its text together, so another text under the same id stays. Of rows
    that repeat both, one stays, unless the text has no words or the id is null.
    """
    name, mark = fresh(docs, "copy_id"), fresh(docs, "copy_mark")
    judged = stage(_judged(docs, similarity).filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "mark", "kept"), "judged")
    keys = [F.col("doc_id").alias(name), F.col("mark").alias(mark)]
    same = (docs["doc_id"].cast("long") == F.col(name)) & (F.xxhash64(docs["text"]) == F.col(mark))
    left = docs.join(few_rows(stage(judged.filter("NOT kept").select(*keys).distinct(), "copies")), same, "left_anti")
    repeated = stage(judged.filter("kept").groupBy("doc_id", "mark").count().filter("count > 1").select(*keys), "repeated")
    if repeated.isEmpty():
        return left
    same = (left["doc_id"].cast("long") == F.col(name)) & (F.xxhash64(left["text"]) == F.col(mark))
    once = left.join(few_rows(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(few_rows(repeated), same, "left_anti").unionByName(once)
