"""Benchmark decontamination by winnowing.

Of the hashes of every ``GRAM`` consecutive words, the smallest in each run of
``width - GRAM + 1`` neighbours is kept as a fingerprint. Two texts that share ``width`` words
share a run and so its smallest hash, whatever surrounds it: no shared span of that length is
missed. Documents and benchmark items meet on fingerprints in a Spark join, and each hit is
extended by comparing the words of the document with every window of the items it met.
An item shorter than ``width`` words is one window; its fingerprint is the hash of all its
words, and documents are hashed at the lengths of such items as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.rolling import ALNUM, Words, chunks, find_words, raw_texts
from vitrine.llm.tables import few_rows, fresh, id_type
from vitrine.session import stage

WIDTH = 10
GRAM = 5
#: Up to so many distinct benchmark fingerprints (8 bytes each) tasks carry them and send hits
#: only; beyond, all fingerprints of the documents are sent to the same join.
FEW_PRINTS = 1_000_000
#: Begins what stands for the id of an item without one.
NO_ID = "\x01no id "

_PRINTS = "n_words long, prints array<long>"


def winnow(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and value of each kept hash, repeated ones left out per run."""
    at, value = words.windows(gram)
    run = width - gram + 1
    n = len(at) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = words.owner[at]
    least = value[:n].copy()
    for i in range(1, run):
        np.minimum(least, value[i : n + i], out=least)
    inside = owner[:n] == owner[run - 1 :]
    least, owner = least[inside], owner[:n][inside]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], least[new]


def _prints(width: int, gram: int, lengths: list[int], whole_short: bool, known: np.ndarray | None):
    """Fingerprints per text, the last column; those in ``known``, if it is given.

    ``lengths`` adds the hashes of all runs of those lengths, ``whole_short`` the hash of a text
    with fewer words than a window has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(batch.num_columns - 1))
            for s, e in chunks(texts):
                words = find_words(texts[s:e], ALNUM, lower=True)
                owner, value = winnow(words, width, gram)
                more = [(owner, value)]
                for length in lengths:
                    at, value = words.windows(length)
                    more.append((words.owner[at], value))
                if whole_short:
                    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
                    more.append((short, words.whole()[short]))
                owner, value = (np.concatenate([m[i] for m in more]) for i in (0, 1))
                if known is not None:
                    near = np.minimum(np.searchsorted(known, value), max(len(known) - 1, 0))
                    met = known[near] == value if len(known) else np.zeros(len(value), bool)
                    owner, value = owner[met], value[met]
                order = np.argsort(owner, kind="stable")
                offsets = np.searchsorted(owner[order], np.arange(e - s + 1)).astype(np.int32)
                prints = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order].view(np.int64)))
                kept = batch.slice(s, e - s).columns[:-1]
                names = [*batch.schema.names[:-1], "n_words", "prints"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(words.counts.astype(np.int64)), prints], names=names)

    return run


def _extend(width: int):
    """Exact hits of one document in the items it shares a fingerprint with."""

    def windows(texts: list[bytes]) -> list[set[tuple[bytes, ...]]]:
        found = []
        for text in texts:
            words = find_words([text], ALNUM, lower=True)
            own = [words.data[a:b] for a, b in zip(words.starts, words.ends)]
            size = min(width, len(own))
            found.append({tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set())
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, set] = {}
        for batch in batches:
            counts, names = [], []
            for text, items in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                words = find_words([text], ALNUM, lower=True)
                own = [words.data[a:b] for a, b in zip(words.starts, words.ends)]
                sought: dict[int, dict[tuple, list[str]]] = {}
                for item in items:
                    raw = (item["text"] or "").encode()
                    if raw not in cache:
                        if len(cache) > 10_000:
                            cache.clear()
                        cache[raw] = windows([raw])[0]
                    for window in cache[raw]:
                        sought.setdefault(len(window), {}).setdefault(window, []).append(item["item"])
                hit, found = np.zeros(len(own), bool), set()
                for size, by_window in sought.items():
                    for i in range(len(own) - size + 1):
                        if (met := by_window.get(tuple(own[i : i + size]))) is not None:
                            hit[i : i + size] = True
                            found.update(met)
                counts.append(int(hit.sum()))
                names.append(sorted(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.list_(pa.string()))],
                names=["row", "n_hit", "items"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` per row of ``docs``: its words inside benchmark windows.

    Words are runs of digits, letters a-z (A-Z lower-cased first) and characters outside ASCII.
    A window is ``width`` consecutive words of an item, or all words of a shorter one. ``items``
    lists the distinct ids, as sorted strings, of items with a window in the document. A null
    or empty text has no words; items without words are left out. An item without an id counts
    for ``n_hit`` and is not listed. Rows with the same ``doc_id`` are judged by their own text each.
    """
    return _judged(docs, benchmark, width, gram).drop("row")


def _judged(docs: DataFrame, benchmark: DataFrame, width: int, gram: int) -> DataFrame:
    """``contamination`` with the ``row`` of each id and text."""
    unnamed = F.concat(F.lit(NO_ID), F.xxhash64("text").cast("string"))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), unnamed).alias("item"), "text").filter("text IS NOT NULL")
    prints = stage(items.mapInArrow(_prints(width, gram, [], True, None), f"item string, {_PRINTS}"), "item-prints")
    lengths = [r[0] for r in prints.filter((F.col("n_words") > 0) & (F.col("n_words") < width)).select("n_words").distinct().collect()]
    wanted = prints.select("item", F.explode("prints").alias("print")).distinct()
    sought = wanted.select("print").distinct()
    few = sought.limit(FEW_PRINTS + 1).count() <= FEW_PRINTS
    known = np.sort(np.array([r[0] for r in sought.collect()], np.int64).view(np.uint64)) if few else None
    # a row is known by its id and its text, so repeated ids with other texts stay apart
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    own = stage(keyed.mapInArrow(_prints(width, gram, lengths, False, known), f"doc_id {id_type(docs)}, row long, {_PRINTS}"), "prints")
    met = own.select("row", F.explode("prints").alias("print")).distinct()
    pairs = stage(met.join(wanted, "print").select("row", "item").distinct(), "met")
    texts = keyed.select("row", "text").join(few_rows(pairs.select("row").distinct()), "row", "left_semi").dropDuplicates(["row"])
    listed = pairs.join(items, "item").groupBy("row").agg(F.collect_set(F.struct("item", "text")).alias("met"))
    found = texts.join(listed, "row").select("row", "text", "met").mapInArrow(_extend(width), "row long, n_hit long, items array<string>")
    named = F.filter("items", lambda i: ~i.startswith(NO_ID))
    return own.select("doc_id", "row", "n_words").join(found, "row", "left").select(
        "doc_id", "row", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(named, F.array().cast("array<string>")).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any benchmark window, with all their columns; a null id stays."""
    name, row = fresh(docs, "found_id"), fresh(docs, "found_row")
    bad = _judged(docs, benchmark, width, GRAM).filter("n_hit > 0").select(F.col("doc_id").alias(name), F.col("row").alias(row)).distinct()
    same = (docs["doc_id"] == F.col(name)) & (F.xxhash64(docs["doc_id"], docs["text"]) == F.col(row))
    return docs.join(few_rows(stage(bad, "contaminated")), same, "left_anti")
