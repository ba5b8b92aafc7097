"""Byte-level byte-pair encoding by tree reduction, and decoding.

Encodings of parts form a monoid: a long run of bytes is halved until the parts are short,
short parts are merged pair by pair, and two neighbours are joined by encoding anew a window of
tokens around the seam. The window doubles until its first token fits the token before it and
its last one the token after it. Then every two neighbours in the whole sequence are an
encoding of their own joined text, which makes the sequence the encoding of the whole, so the
tokens outside the window cannot change. Texts are cut into matches of the vocabulary's
pattern first, whose encodings concatenate. Decoding concatenates the bytes of the tokens.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from vitrine.llm.rolling import raw_texts
from vitrine.llm.tables import fresh

LEAF = 32
#: Words, and neighbours of tokens, that a task remembers before it starts anew.
REMEMBERED, REMEMBERED_PAIRS = 300_000, 200_000

_LETTER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\t-\r \u0085\u00a0"


def _latin(pattern: str) -> str:
    """The pattern with its classes written out for texts of Latin-1, which ``re`` runs faster."""
    spelled = {r"\p{L}": _LETTER, r"\p{N}": _NUMBER, r"\s": _SPACE}
    out, inside = [], False
    for token in re.findall(r"\\p\{[LN]\}|\\[sS]|.", pattern):
        inside = token == "[" or (inside and token != "]")
        if token == r"\S":
            token = f"[^{_SPACE}]"
        elif token in spelled:
            token = spelled[token] if inside else f"[{spelled[token]}]"
        out.append(token)
    return "".join(out)


class _Words(dict):
    """Packed ids of the words met so far; a new word is encoded when it is asked for."""

    def __init__(self, reduce) -> None:
        super().__init__()
        self._reduce = reduce

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self._reduce(word.encode()), np.int32).tobytes()
        if len(word) <= 4 * LEAF:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Ranks of byte strings, and the encodings of the words met so far."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as source:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
        self.bytes = {rank: token for token, rank in self.ranks.items()}
        self.tokens = pa.array([self.bytes.get(i) for i in range(max(self.bytes) + 1)], pa.binary())
        self._pattern = regex.compile(pattern)
        self._latin = re.compile(_latin(pattern))
        self._fits: dict[tuple[int, int], bool] = {}
        self._words = _Words(self.reduce)

    def leaf(self, raw: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, the leftmost first, until none can be merged."""
        ranks = self.ranks
        if (whole := ranks.get(raw)) is not None:
            return [whole]
        if len(raw) > 2 * LEAF:
            return self._long(raw)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(raw[i : i + 2], 1 << 40) for i in range(len(raw) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 40:
                break
            i = pairs.index(least)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = ranks.get(joined + parts[i + 1], 1 << 40)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + joined, 1 << 40)
        return [ranks[p] for p in parts]

    def _long(self, raw: bytes) -> list[int]:
        """The same merges with a heap of pairs, for windows that grew long."""
        ranks, n = self.ranks, len(raw)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or after[i] >= n or end[after[i]] != stop or gone[after[i]]:
                continue
            right = after[i]
            gone[right] = 1
            end[i], after[i] = stop, after[right]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(raw[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if before[i] >= 0 and (r := ranks.get(raw[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[raw[i : end[i]]])
            i = after[i]
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens are the encoding of their joined bytes."""
        key = (left, right)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) >= REMEMBERED_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self.leaf(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the joined bytes of two encodings."""
        if not left or not right:
            return left + right
        if self.fits(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.leaf(self.decode(left[len(left) - i :] + right[:j]))
            good_left = i == len(left) or self.fits(left[len(left) - i - 1], window[0])
            good_right = j == len(right) or self.fits(window[-1], right[j])
            if good_left and good_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = (i if good_left else 2 * i), (j if good_right else 2 * j)

    def reduce(self, raw: bytes) -> list[int]:
        """Encode halves, then join them."""
        if len(raw) <= LEAF:
            return self.leaf(raw)
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        half = len(raw) // 2
        return self.join(self.reduce(raw[:half]), self.reduce(raw[half:]))

    def packed(self, text: str) -> bytes:
        """Ids of a text as consecutive 32-bit numbers."""
        try:
            text.encode("latin-1")
            words = self._latin.findall(text)
        except UnicodeEncodeError:
            words = self._pattern.findall(text)
        return b"".join(map(self._words.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def forget(self) -> None:
        """Let go of the words met: between tasks a worker only waits."""
        self._words.clear()
        self._fits.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


#: Bytes of text, or token ids, whose lists are held at once; a longer text is handled alone.
SLICE = 1 << 20


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with about ``SLICE`` in all."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > SLICE:
            yield start, i
            start, total = i, 0
        total += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def encoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of every whole text, without special tokens.

    A null or empty text has no tokens. All columns of ``docs`` stay.
    """
    from pyspark.sql import types as T

    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            texts = raw_texts(batch.column(place))
            for s, e in _slices([len(t) for t in texts]):
                part, found = batch.slice(s, e - s), [own.packed(t.decode()) for t in texts[s:e]]
                offsets = np.cumsum([0, *map(len, found)], dtype=np.int32) // 4
                flat = np.frombuffer(b"".join(found), np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, ids])
        own.forget()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decoded(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes its token ids stand for; null ids stand for none."""
    from pyspark.sql import types as T

    place = docs.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(place)).fill_null(0).to_pylist()
            for s, e in _slices(sizes):
                part = batch.slice(s, e - s)
                counts = np.cumsum([0, *sizes[s:e]])
                if not counts[-1]:
                    none = pa.array([b""] * (e - s), pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns, none], names=[*batch.schema.names, out])
                    continue
                # the tokens' bytes lie one after the other, so a text is a stretch of them
                tokens = own.tokens.take(part.column(place).flatten())
                ends = np.frombuffer(tokens.buffers()[1], np.int32)[: counts[-1] + 1]
                offsets = pa.py_buffer(np.ascontiguousarray(ends[counts]))
                found = pa.Array.from_buffers(pa.binary(), e - s, [None, offsets, tokens.buffers()[2]])
                yield pa.RecordBatch.from_arrays([*part.columns, found], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The documents with their token ids, under names that clash with no column."""
    return encoded(docs, path, pattern, fresh(docs, "ids"))
