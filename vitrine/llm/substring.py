"""Substring deduplication: word windows that an earlier document already holds are removed.

Every run of ``width`` words gets two Rabin-Karp hashes. One chooses a bucket, the other is
the value counted in it, so a window is told apart by 64 bits and those of the bucket number,
and the number of buckets grows with the input. Tasks send each bucket, for a few thousand
documents at a time, the values that no smaller document of theirs has; so a window that a
third of all documents share reaches its bucket once per such batch and not once per document.
A bucket answers each document with the places of its repeated values. Overlapping repeated
windows merge into maximal intervals, which are cut from the text.

Only windows' hashes and answers are shuffled besides one pass of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.rolling import SPACED, Words, chunks, find_words, raw_texts

WIDTH = 13
#: Windows a bucket should hold, and windows whose values a task compares before sending.
BUCKET_WINDOWS = 2_500_000
BATCH_WINDOWS = 1_000_000
LEAST_BUCKETS = 64

_SENT = "bucket int, docs binary, marks binary, counts binary, known binary, hashes binary"
_ANSWER = "bucket int, doc_id long, mark int, places array<int>"


def bucket_count(docs: DataFrame) -> int:
    """Buckets for the input's windows, from the bytes of its texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-size // 6 // BUCKET_WINDOWS))


def _sent(parts: list[tuple], buckets: int) -> pa.RecordBatch:
    """What a batch of documents, ordered by id, tells each bucket."""
    ids, marks = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    doc = np.concatenate([p[2] + sum(len(q[0]) for q in parts[:i]) for i, p in enumerate(parts)])
    value, bucket = (np.concatenate([p[i] for p in parts]) for i in (3, 4))
    rank = np.argsort(ids, kind="stable")
    place = np.empty_like(rank)
    place[rank] = np.arange(len(rank))
    # equal values side by side, the smallest document first, a document's own in text order
    by_doc = np.argsort(place[doc], kind="stable")
    order = by_doc[np.argsort(value[by_doc], kind="stable")]
    v, d = value[order], doc[order]
    run = np.r_[True, v[1:] != v[:-1]]
    first = run | np.r_[True, d[1:] != d[:-1]]
    least = ids[d[run]][np.cumsum(run) - 1]
    entry, known = order[first], (ids[d] > least)[first]
    back = np.argsort(entry)
    entry, known = entry[back], known[back]
    by_bucket = np.argsort(bucket[entry], kind="stable")
    entry, known = entry[by_bucket], known[by_bucket]
    b, d, v = bucket[entry], doc[entry], value[entry]
    slot = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (d[1:] != d[:-1])])
    counts = np.diff(np.r_[slot, len(b)]).astype(np.uint32)
    names, at = np.unique(b, return_index=True)
    slots = np.searchsorted(slot, np.r_[at, len(b)])
    at = np.r_[at, len(b)]
    rows = []
    for i, name in enumerate(names):
        s, e = slice(slots[i], slots[i + 1]), slice(at[i], at[i + 1])
        own = d[slot[s]]
        rows.append((name, ids[own].tobytes(), marks[own].tobytes(), counts[s].tobytes(),
                     np.packbits(known[e]).tobytes(), v[e][~known[e]].tobytes()))
    kinds = (pa.int32(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
        names=["bucket", "docs", "marks", "counts", "known", "hashes"],
    )


def _windows(words: Words, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at, value = words.windows(width)
    _, other = words.windows(width, 1)
    return at, value, (other % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)


def _send(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids, marks = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = raw_texts(batch.column(2))
            for s, e in chunks(texts):
                words = find_words(texts[s:e], SPACED)
                at, value, bucket = _windows(words, width, buckets)
                if len(at):
                    held.append((ids[s:e].astype(np.int64), marks[s:e].astype(np.int32), words.owner[at], value, bucket))
                    size += len(at)
                if size >= BATCH_WINDOWS:
                    yield _sent(held, buckets)
                    held, size = [], 0
        if held:
            yield _sent(held, buckets)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Places, within each document's list for this bucket, of values a smaller document has."""
    if not len(table):
        return pa.table({"bucket": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()),
                         "mark": pa.array([], pa.int32()), "places": pa.array([], pa.list_(pa.int32()))})
    bucket = table["bucket"][0].as_py()

    def joined(name: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(table[name].to_pylist()), kind)

    docs, marks, counts = joined("docs", np.int64), joined("marks", np.int32), joined("counts", np.uint32)
    known = np.concatenate([
        np.unpackbits(np.frombuffer(k, np.uint8), count=int(np.frombuffer(c, np.uint32).sum()))
        for k, c in zip(table["known"].to_pylist(), table["counts"].to_pylist())
    ]).astype(bool)
    hashes = joined("hashes", np.uint64)
    slot = np.repeat(np.arange(len(docs), dtype=np.int32), counts)
    open_at = np.flatnonzero(~known)
    order = np.argsort(hashes)
    ids = docs[slot[open_at[order]]]
    hashes = hashes[order]
    run = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
    del hashes
    if len(run):
        least = np.minimum.reduceat(ids, np.flatnonzero(run))[np.cumsum(run) - 1]
        known[open_at[order[ids > least]]] = True
    hit = np.flatnonzero(known)
    places = (hit - (np.cumsum(counts) - counts)[slot[hit]]).astype(np.int32)
    hits = np.bincount(slot[hit], minlength=len(docs))
    some = np.flatnonzero(hits)
    offsets = np.r_[0, np.cumsum(hits[some])].astype(np.int32)
    return pa.table({
        "bucket": pa.array(np.full(len(some), bucket, np.int32)), "doc_id": pa.array(docs[some]),
        "mark": pa.array(marks[some]), "places": pa.ListArray.from_arrays(pa.array(offsets), pa.array(places)),
    })


def _covered(value: np.ndarray, bucket: np.ndarray, at: np.ndarray, n_words: int, width: int, answers) -> np.ndarray:
    """Words of one document under a repeated window."""
    _, first, inverse = np.unique(value, return_index=True, return_inverse=True)
    by_place = np.argsort(first)
    names = bucket[first[by_place]]
    listed = by_place[np.argsort(names, kind="stable")]
    names = np.sort(names)
    repeated = np.zeros(len(first), bool)
    for name, places in answers:
        repeated[listed[np.searchsorted(names, name) + places]] = True
    hit = at[repeated[inverse]]
    steps = np.zeros(n_words + 1, np.int32)
    np.add.at(steps, hit, 1)
    np.add.at(steps, hit + width, -1)
    return np.cumsum(steps[:-1]) > 0


def _cut(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, answers = raw_texts(batch.column(1)), batch.column(2)
            told = answers.is_valid().to_numpy(zero_copy_only=False)
            n_words, n_removed, kept = [], [], []
            for s, e in chunks(texts):
                some = np.flatnonzero(told[s:e]) + s
                words = find_words([texts[i] for i in some], SPACED)
                at, value, bucket = _windows(words, width, buckets)
                cuts = np.searchsorted(at, words.first)
                turn = 0
                for i in range(s, e):
                    own = texts[i].split()
                    n_words.append(len(own))
                    gone = 0
                    if told[i]:
                        part = slice(cuts[turn], cuts[turn + 1])
                        replies = [(r["bucket"], np.asarray(r["places"])) for r in answers[i].as_py()]
                        under = _covered(value[part], bucket[part], at[part] - words.first[turn], len(own), width, replies)
                        gone = int(under.sum())
                        own = [own[j] for j in np.flatnonzero(~under)]
                        turn += 1
                    n_removed.append(gone)
                    kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: each text without its repeated windows.

    A word goes if some window of ``width`` words over it also starts in a document with a
    smaller ``doc_id``; windows are judged on the input. The words that stay are joined by one
    space. A null or empty text has no words. Rows that share a ``doc_id`` count as one
    document and never remove each other's words; a null ``doc_id`` is neither smaller nor
    larger than another, so its row stays whole and removes nothing.
    """
    buckets = buckets or bucket_count(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("mark"))
    sent = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "mark", "text").mapInArrow(_send(width, buckets), _SENT)
    answers = (
        sent.groupBy("bucket").applyInArrow(_answer, _ANSWER)
        .groupBy("doc_id", "mark").agg(F.collect_list(F.struct("bucket", "places")).alias("answers"))
    )
    joined = rows.join(answers.hint("merge"), ["doc_id", "mark"], "left").select("doc_id", "text", "answers")
    return joined.mapInArrow(_cut(width, buckets), "doc_id long, n_words long, n_removed long, text string")
