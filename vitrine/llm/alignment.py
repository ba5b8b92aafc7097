"""Alignment of two tokenizers over a corpus: groups of tokens, and how often ids are linked.

Each text is encoded by two tokenizers whose tokens are spans of the same bytes. Where tokens
of both end at one byte a group ends; two tokens are linked where their spans overlap. How
often each pair of ids is linked in the whole corpus is counted by external spilling: tasks
turn links into pair-document records, sort them by the second tokenizer's id, then the first's
(side-major), partition them by the radix of the second id and store every part as a run of
zstd frames in the shared folder. Runs of a part are merged with a heap, a frame of each at a
time, which counts the pairs in side-major order, so that the highest count of a second id is
known when its pairs end. A second pass over the same runs streams every record's contribution
back to its document.

A single space between two characters that are no white space begins a token of either kind, so
texts are cut there and every distinct unit is encoded and aligned once by a task.

A part's runs are dealt to groups of bounded bytes, so that an id that a third of all links
share is counted and streamed by many tasks, each of which holds its runs compressed.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vitrine.session import stage

#: Radix of the second tokenizer's id; links a task holds before it stores them as runs.
PARTS = 32
RUN_LINKS = 1_500_000
#: Records of a frame, and bytes of compressed runs that one task merges.
FRAME = 1 << 14
GROUP_BYTES = 32 << 20
#: Characters of text aligned at once; a longer text is aligned alone.
SLICE = 1 << 21
#: Units encoded as one line; units, and their characters, that a task remembers before it starts anew.
LINE, REMEMBERED, REMEMBERED_CHARS = 50, 500_000, 16 << 20

_SPACE = "▁"
_CUT, _WIDE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


def _byte_of() -> dict[str, int]:
    """Byte that each character of a byte-level vocabulary stands for.

    Printable characters of Latin-1 stand for themselves; the other bytes, in their order, for
    the characters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Two tokenizers, the bytes of their tokens, and the texts of ids with their separators."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._a.no_truncation()
        self._a.no_padding()
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        entries = self._a.get_vocab(with_added_tokens=True)
        self.n_a, self.n_b = max(entries.values()) + 1, self._b.get_piece_size()
        bytes_a = [b""] * self.n_a
        for entry, i in entries.items():
            known = all(c in byte_of for c in entry)
            bytes_a[i] = bytes(map(byte_of.__getitem__, entry)) if known else entry.encode()
        bytes_b = []
        for i in range(self.n_b):
            piece = self._b.id_to_piece(i)
            if _SPACE in piece.lstrip(_SPACE):
                raise ValueError(f"piece {i} has a space behind another character, so texts have no safe cuts")
            bytes_b.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace(_SPACE, " ").encode())
        self._bytes = [pa.array(b, pa.binary()) for b in (bytes_a, bytes_b)]
        self._sizes = [np.array([len(b) for b in s], np.int64) for s in (bytes_a, bytes_b)]
        self._top = max(self.n_a, self.n_b)
        self._texts = pa.array([f"{i}{mark}".encode() for mark in ",|;" for i in range(self._top)], pa.binary())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by both, one text after the other, each behind a space for the first."""
        found = self._a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False), self._b.encode(texts, num_threads=1)
        sides = [e.ids for e in found[0]], found[1]
        return tuple(np.fromiter(chain.from_iterable(side), np.int64) for side in sides)

    def spelled(self, side: int, ids: np.ndarray) -> bytes:
        """The joined bytes of tokens."""
        return _values(self._bytes[side].take(pa.array(ids)))

    def ends(self, side: int, ids: np.ndarray) -> np.ndarray:
        """Byte behind each token."""
        return np.cumsum(self._sizes[side][ids])

    def written(self, ids: np.ndarray, marks: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Decimal ids, each with a comma (0), bar (1) or semicolon (2), and their ends."""
        found = self._texts.take(pa.array(ids + marks * self._top))
        ends = np.frombuffer(found.buffers()[1], np.int32)[1 : len(ids) + 1]
        return _values(found), ends


def _values(found: pa.Array) -> bytes:
    """The values of a fresh binary array, one after the other."""
    ends = np.frombuffer(found.buffers()[1], np.int32)
    return found.buffers()[2].to_pybytes()[: ends[len(found)]] if len(found) else b""


@lru_cache(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    return Tokenizers(path_a, path_b)


class Encoded:
    """The alignment of several units, as flat arrays; units that do not spell out are empty."""

    def __init__(self, own: Tokenizers, units: list[str]) -> None:
        self._own = own
        n = len(units)
        sizes = np.array([len(u.encode()) + 1 for u in units], np.int64)
        # units that white space does not border are encoded as lines, which are cut between them
        whole = [i for i, u in enumerate(units) if not (u[0].isspace() or u[-1].isspace())]
        lines = [" ".join([units[i] for i in whole[k : k + LINE]]) for k in range(0, len(whole), LINE)]
        ids = own.encode(lines)
        if any(own.spelled(s, ids[s]) != "".join([" " + t for t in lines]).encode() for s in (0, 1)):
            whole, ids = [], own.encode([])
        parts, order = [ids], list(whole)
        for i in sorted(set(range(n)) - set(whole)):
            one = own.encode([units[i]])
            if all(own.spelled(s, one[s]) == b" " + units[i].encode() for s in (0, 1)):
                parts.append(one)
                order.append(i)
        self.a, self.b = (np.concatenate([p[s] for p in parts]) for s in (0, 1))
        #: units in the order of the arrays, and the bytes behind each
        self.order = np.array(order, np.int64)
        unit_ends = np.cumsum(sizes[self.order])
        self._ends = own.ends(0, self.a), own.ends(1, self.b)
        seams = np.sort(np.concatenate(self._ends), kind="stable")
        twice = np.r_[seams[1:] == seams[:-1], False] if len(seams) else np.zeros(0, bool)
        self._cuts = seams[twice]
        seams = seams[~twice]
        #: one link for each stretch between neighbouring token ends: the tokens it lies in
        self.link_a = self.a[np.searchsorted(self._ends[0], seams)]
        self.link_b = self.b[np.searchsorted(self._ends[1], seams)]
        count = [np.bincount(np.searchsorted(unit_ends, e), minlength=len(order)) for e in (*self._ends, self._cuts, seams)]
        self.n_a, self.n_b, self.n_groups, self.n_links = count

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3;`` of every unit, in the order of the arrays."""
        n_a, n_b = len(self.a), len(self.b)
        group_a, group_b = (np.searchsorted(self._cuts, e) for e in self._ends)
        last_a, last_b = (np.isin(e, self._cuts, assume_unique=True) for e in self._ends)
        upto_a = np.searchsorted(group_a, np.arange(len(self._cuts)), "right")
        before_b = np.searchsorted(group_b, np.arange(len(self._cuts)), "left")
        order = np.empty(n_a + n_b, np.int64)
        marks = np.zeros(n_a + n_b, np.int64)
        place_a, place_b = np.arange(n_a) + before_b[group_a], np.arange(n_b) + upto_a[group_b]
        order[place_a], order[place_b] = self.a, self.b
        marks[place_a[last_a]], marks[place_b[last_b]] = 1, 2
        data, ends = self._own.written(order, marks)
        stops = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)])
        bounds = np.concatenate([[0], ends])[stops].tolist()
        return [data[s:e] for s, e in zip(bounds, bounds[1:])]


class _Places(dict):
    """Numbers of units, given out as new ones are asked for."""

    def __missing__(self, unit: str) -> int:
        place = self[unit] = len(self)
        return place


class Units:
    """Alignments of the units that a task has met."""

    def __init__(self, own: Tokenizers) -> None:
        self._own = own
        self._forget()

    def _forget(self) -> None:
        self._at = _Places()
        self._chars = 0
        self.n_a = self.n_b = self.n_groups = self.n_links = self.first_link = np.zeros(0, np.int64)
        self.link_a = self.link_b = np.zeros(0, np.int64)
        self.texts = pa.array([], pa.large_binary())

    def _learn(self, units: list[str]) -> None:
        found = Encoded(self._own, units)
        self._chars += sum(map(len, units))
        before = len(self.link_a)
        self.link_a, self.link_b = np.r_[self.link_a, found.link_a], np.r_[self.link_b, found.link_b]

        def placed(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(units), np.int64)
            out[found.order] = values
            return out

        for name in ("n_a", "n_b", "n_groups", "n_links"):
            setattr(self, name, np.r_[getattr(self, name), placed(getattr(found, name))])
        self.first_link = np.r_[self.first_link, placed(np.cumsum(found.n_links) - found.n_links + before)]
        texts = [b""] * len(units)
        for i, text in zip(found.order.tolist(), found.groups()):
            texts[i] = text
        self.texts = pa.concat_arrays([self.texts, pa.array(texts, pa.large_binary())])

    def align(self, texts: list[str]) -> Aligned:
        # the mark that pieces use for a space cannot be spelled, so such a text has no tokens
        units = [_units(t) if t and _SPACE not in t else [] for t in texts]
        if len(self._at) > REMEMBERED or self._chars > REMEMBERED_CHARS:
            self._forget()
        known = len(self._at)
        counts = np.array([len(u) for u in units], np.int64)
        places = np.fromiter(map(self._at.__getitem__, chain.from_iterable(units)), np.int64, int(counts.sum()))
        if len(self._at) > known:
            self._learn(list(islice(self._at, known, None)))
        return Aligned(self, places, counts)


def _units(text: str) -> list[str]:
    if _WIDE.search(text) or text[0].isspace() or text[-1].isspace():
        return _CUT.split(text)
    return text.split(" ")


class Aligned:
    """The alignment of several texts out of those of their units."""

    def __init__(self, known: Units, places: np.ndarray, counts: np.ndarray) -> None:
        n = len(counts)
        owner = np.repeat(np.arange(n), counts)
        lost = np.zeros(n, bool)
        lost[owner[known.n_a[places] == 0]] = True
        if lost.any():
            stay = ~lost[owner]
            places, owner = places[stay], owner[stay]
        totals = np.zeros((4, n), np.int64)
        for total, own in zip(totals, (known.n_a, known.n_b, known.n_groups, known.n_links)):
            np.add.at(total, owner, own[places])
        self.n_a, self.n_b, self.n_groups, self.n_links = totals
        links = known.n_links[places]
        starts = known.first_link[places]
        at = np.arange(int(links.sum())) + np.repeat(starts - (np.cumsum(links) - links), links)
        self.link_a, self.link_b, self.link_text = known.link_a[at], known.link_b[at], np.repeat(owner, links)
        self._texts, self._first = known.texts.take(pa.array(places)), np.searchsorted(owner, np.arange(n + 1))

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        if not len(self._texts):
            return [b""] * len(self.n_a)
        bounds = np.frombuffer(self._texts.buffers()[1], np.int64)[self._first].tolist()
        data = self._texts.buffers()[2]
        return [bytes(memoryview(data)[s : max(s, e - 1)]) for s, e in zip(bounds, bounds[1:])]


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > SLICE:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising numbers and their counts as one zstd frame: steps by byte planes, then counts."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes() + counts.astype(np.uint32).tobytes())


def unpacked(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).reshape(-1).view(np.uint64)
    return np.cumsum(steps, dtype=np.uint64), raw[8 * n :].view(np.uint32)


class Spill:
    """Links of the documents met so far, until they are stored as runs."""

    def __init__(self, n_a: int, n_b: int) -> None:
        self._n_a, self._rows = n_a, -(-n_b // PARTS)
        self._held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.links = self.docs = 0

    def add(self, found: Aligned, docs: int) -> None:
        self._held.append((found.link_a, found.link_b, found.link_text + self.docs))
        self.links += len(found.link_a)
        self.docs += docs

    def runs(self) -> Iterator[tuple[int, int, list[bytes]]]:
        """``part, documents, frames`` of each part, and forget the links.

        A record is one number, ``(pair, document)`` with the pair's second id first, and how
        often the document holds the pair.
        """
        a, b, doc = (np.concatenate([h[i] for h in self._held]) for i in range(3)) if self._held else [np.zeros(0, np.int64)] * 3
        docs = max(self.docs, 1)
        place = (b % PARTS) * self._rows + b // PARTS
        record, count = np.unique(((place * self._n_a + a) * docs + doc).astype(np.uint64), return_counts=True)
        bounds = np.searchsorted(record, np.arange(PARTS + 1, dtype=np.uint64) * np.uint64(self._rows * self._n_a * docs))
        for part in range(PARTS):
            s, e = int(bounds[part]), int(bounds[part + 1])
            if s < e:
                yield part, docs, [packed(record[i : min(i + FRAME, e)], count[i : min(i + FRAME, e)]) for i in range(s, e, FRAME)]
        self._held, self.links, self.docs = [], 0, 0


_STORED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, row long, part int, base long, docs long, frames array<binary>"


def _spill(path_a: str, path_b: str, id_type: pa.DataType):
    """Rows of documents (with ``row``) and of runs (with ``part``)."""
    names = [f.split()[0] for f in _STORED.split(", ")]
    kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.binary())]

    def batch_of(ids: pa.Array, **columns) -> pa.RecordBatch:
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds))], names=["doc_id", *names]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(path_a, path_b)
        known, spill = Units(own), Spill(own.n_a, own.n_b)
        row = base = TaskContext.get().partitionId() << 40

        def stored() -> pa.RecordBatch:
            docs = spill.docs
            runs = list(spill.runs())
            return batch_of(
                pa.nulls(len(runs), id_type), part=[r[0] for r in runs], base=[base] * len(runs),
                docs=[docs] * len(runs), frames=[r[2] for r in runs],
            )

        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s, e in _slices(texts):
                found = known.align(texts[s:e])
                digests = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(found.groups(), found.n_a)]
                yield batch_of(
                    batch.column(0).slice(s, e - s), n_a=found.n_a, n_b=found.n_b, n_groups=found.n_groups,
                    n_links=found.n_links, groups_sha256=digests, row=np.arange(row, row + e - s),
                )
                spill.add(found, e - s)
                row += e - s
                if spill.links >= RUN_LINKS:
                    yield stored()
                    base = row
        yield stored()

    return run


def merged(runs: list[tuple[int, list[bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts over ``(documents, frames)`` runs, in rising order of the pairs.

    A heap holds the last pair of every run's frame. All records up to the least of them are
    merged, then that run's next frame is read, so that one frame of each run is held at a
    time. A pair may come again in the next piece.
    """
    heap, held, rest = [], {}, {i: iter(frames) for i, (_, frames) in enumerate(runs)}

    def read(i: int) -> None:
        frame = next(rest[i], None)
        if frame is None:
            held.pop(i, None)
            return
        records, counts = unpacked(frame)
        held[i] = [records // np.uint64(runs[i][0]), counts, 0]
        heapq.heappush(heap, (int(held[i][0][-1]), i))

    for i in range(len(runs)):
        read(i)
    while heap:
        bound, least = heapq.heappop(heap)
        pairs, counts = [], []
        for one in held.values():
            upto = int(np.searchsorted(one[0], np.uint64(bound), "right"))
            if upto > one[2]:
                pairs.append(one[0][one[2] : upto])
                counts.append(one[1][one[2] : upto])
                one[2] = upto
        read(least)
        if pairs:
            pair, count = np.concatenate(pairs), np.concatenate(counts).astype(np.int64)
            order = np.argsort(pair, kind="stable")
            pair, count = pair[order], count[order]
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            yield pair[first], np.add.reduceat(count, first)


def _count(table: pa.Table) -> pa.Table:
    """Links of each pair in one group of runs."""
    runs = list(zip(table["docs"].to_pylist(), table["frames"].to_pylist()))
    found = list(merged(runs))
    pair = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint64)
    links = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    # a pair that two pieces share comes twice in a row
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    if len(pair):
        pair, links = pair[first], np.add.reduceat(links, first)
    part = np.full(len(pair), table["part"][0].as_py() if len(table) else 0, np.int32)
    return pa.table({"part": part, "pair": pair.astype(np.int64), "links": links})


def _contribute(runs: pa.Table, counted: pa.Table) -> pa.Table:
    """What the records of one group of runs add to their documents."""
    pairs = counted["pair"].to_numpy()
    order = np.argsort(pairs)
    pairs, links = pairs[order], counted["links"].to_numpy()[order]
    best = counted["best"].to_numpy()[order].astype(np.int64)
    rows, n_best, sums = [], [], []
    for base, docs, frames in zip(runs["base"].to_pylist(), runs["docs"].to_pylist(), runs["frames"].to_pylist()):
        total = np.zeros((2, docs), np.int64)
        met = np.zeros(docs, bool)
        for frame in frames:
            records, counts = unpacked(frame)
            at = np.searchsorted(pairs, (records // np.uint64(docs)).astype(np.int64))
            doc = (records % np.uint64(docs)).astype(np.int64)
            counts = counts.astype(np.int64)
            np.add.at(total[0], doc, counts * best[at])
            np.add.at(total[1], doc, counts * links[at])
            met[doc] = True
        own = np.flatnonzero(met)
        rows.append(own + base)
        n_best.append(total[0][own])
        sums.append(total[1][own])
    joined = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (rows, n_best, sums))
    return pa.table(dict(zip(("row", "n_best", "count_sum"), joined)))


class Alignment:
    """``documents``: one row per document; ``pairs``: ``a_id, b_id, links, best``."""

    def __init__(self, documents: DataFrame, pairs: DataFrame) -> None:
        self.documents, self.pairs = documents, pairs


def align(docs: DataFrame, path_a: str, path_b: str) -> Alignment:
    """Align a byte-level tokenizer (.json) with a piece model (.model) over ``doc_id, text``.

    ``documents`` has ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    for every row, ``pairs`` every linked pair of ids, how often it is linked in the corpus, and
    whether that is the highest count of its second id. A text that is null, empty or whose
    tokens do not spell it out has no tokens: zeros and ``''``. Repeated rows and null ids count
    one by one; other columns are left out. An empty table gives no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    own = tokenizers(path_a, path_b)
    n_a, places = own.n_a, -(-own.n_b // PARTS)
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_STORED}"
    stored = stage(rows.mapInArrow(_spill(path_a, path_b, id_type), schema), "aligned")
    runs = stored.filter("part IS NOT NULL").select("part", "base", "docs", "frames")
    size = F.aggregate("frames", F.lit(0).cast("long"), lambda total, f: total + F.length(f))
    sizes = {r["part"]: r["size"] for r in runs.groupBy("part").agg(F.sum(size).alias("size")).collect()}
    salts = F.lit(1)
    for part, total in sizes.items():
        if total > GROUP_BYTES:
            salts = F.when(F.col("part") == part, -(-total // GROUP_BYTES)).otherwise(salts)
    dealt = runs.withColumn("salt", F.pmod(F.xxhash64("base"), salts.cast("long")))
    counted = dealt.groupBy("part", "salt").applyInArrow(_count, "part int, pair long, links long")
    total = counted.groupBy("part", "pair").agg(F.sum("links").alias("links"))
    # the pair's number is (second id's place) * n_a + first id
    place = F.expr(f"pair div {n_a}")
    highest = F.max("links").over(Window.partitionBy("place"))
    pairs = stage(total.withColumn("place", place).withColumn("best", F.col("links") == highest), "pairs")
    copies = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts.cast("long") - 1)))
    added = (
        dealt.groupBy("part", "salt")
        .cogroup(copies.select("part", "salt", "pair", "links", "best").groupBy("part", "salt"))
        .applyInArrow(_contribute, "row long, n_best long, count_sum long")
        .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    documents = stored.filter("row IS NOT NULL").select("doc_id", *numbers, "groups_sha256", "row").join(added, "row", "left")
    zero = F.lit(0).cast("long")
    documents = documents.select(
        "doc_id", *numbers, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )
    b_id = F.col("place") % places * PARTS + F.expr(f"place div {places}")
    return Alignment(documents, pairs.select((F.col("pair") % n_a).alias("a_id"), b_id.alias("b_id"), "links", "best"))


def group_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, groups``: the aligned groups of every text as ``a1,a2|b1;a3|b2,b3``, '' without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Units(tokenizers(path_a, path_b))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s, e in _slices(texts):
                found = pa.array(known.align(texts[s:e]).groups(), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, e - s), found], names=["doc_id", "groups"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, groups string")
