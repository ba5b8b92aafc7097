"""Token counts of every prefix by dynamic programming over a byte-pair vocabulary.

In a correct encoding every two neighbouring tokens are an encoding of their own joined text,
and a prefix of a correct encoding is one too. So the last token of a prefix is the one that
ends there and fits the last token of what stands before it; one number per place, the count
before it plus one, is the whole table. Words end in tokens of their own kind, so a prefix cut
inside a word is closed by one more step of the same kind. Counts of words and of their inner
prefixes come from the table, which answers how long a text is, and where to cut it for a
budget, without encoding anything again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from vitrine.llm.rolling import raw_texts

#: Words a task remembers before it starts anew.
REMEMBERED = 300_000

#: The rule that cuts a normalised text into words, and the same rule for texts of Latin-1.
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_LETTER = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_SPACE = "\t-\r \u0085\u00a0"
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Open tokens, tokens that end a word, merge ranks, and which neighbours fit."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model, symbols = spec["model"], byte_symbols()
        suffix = model["end_of_word_suffix"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        self.text: dict[int, bytes] = {}
        for token, number in model["vocab"].items():
            ends = token.endswith(suffix) and token != suffix
            raw = token.removesuffix(suffix) if ends else token
            if all(c in symbols for c in raw):
                text = bytes(symbols[c] for c in raw)
                (self.closed if ends else self.open)[text] = number
                self.text[number] = text
        vocab = model["vocab"]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if (a in vocab) and (b in vocab) and (joined := vocab.get(a + b)) is not None:
                self.merges.setdefault((vocab[a], vocab[b]), (rank, joined))
        self.longest = max(map(len, self.open | self.closed))
        self._fits: dict[tuple[int, int, bool], bool] = {}

    def merge(self, text: bytes, closed: bool) -> list[int]:
        """Byte-pair encoding of a short text by its definition."""
        last = len(text) - 1
        ids = [(self.closed if closed and i == last else self.open)[text[i : i + 1]] for i in range(len(text))]
        while len(ids) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merges[ids[i], ids[i + 1]][1]]
        return ids

    def fits(self, left: int, right: int, closed: bool) -> bool:
        """Whether ``right`` may follow ``left`` (-1: nothing) in a correct encoding."""
        key = (left, right, closed)
        if (known := self._fits.get(key)) is None:
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            before = self.text[left] if left >= 0 else b""
            wanted = [left, right] if left >= 0 else [right]
            known = self._fits[key] = self.merge(before + self.text[right], closed) == wanted
        return known

    def step(self, word: bytes, end: int, last: list[int], closed: bool) -> int:
        """Where the last token of ``word[:end]`` begins; -1 if no token fits."""
        tokens = self.closed if closed else self.open
        for start in range(max(0, end - self.longest), end):
            number = tokens.get(word[start:end])
            if number is not None and (start == 0 or last[start] >= 0) and self.fits(last[start] if start else -1, number, closed):
                return start
        raise ValueError("the vocabulary lacks a byte")

    def table(self, word: bytes) -> tuple[list[int], list[int]]:
        """Last token and count of every open prefix of a word, the empty one first."""
        last, count = [-1], [0]
        for end in range(1, len(word)):
            start = self.step(word, end, last, False)
            last.append(self.open[word[start:end]])
            count.append(count[start] + 1)
        return last, count


class Counter:
    """Prefix tables of words, kept while they are asked for."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        specials = "|".join(re.escape(s) for s in sorted(self.vocabulary.specials, key=len, reverse=True))
        self._specials = re.compile(f"({specials})") if specials else None
        self._tables: dict[str, tuple[bytes, list[int], list[int], int]] = {}

    def word(self, word: str) -> tuple[bytes, list[int], list[int], int]:
        """A word's bytes, its open prefixes' last tokens and counts, and its own count."""
        if (known := self._tables.get(word)) is None:
            if len(self._tables) >= REMEMBERED:
                self._tables.clear()
            raw = word.encode()
            last, count = self.vocabulary.table(raw)
            total = count[self.vocabulary.step(raw, len(raw), last, True)] + 1
            known = self._tables[word] = (raw, last, count, total)
        return known

    def inside(self, word: str, n_chars: int) -> int:
        """Tokens of the first characters of a word as a text that ends there."""
        raw, last, count, total = self.word(word)
        end = len(word[:n_chars].encode())
        if end == len(raw):
            return total
        return count[self.vocabulary.step(raw, end, last, True)] + 1 if end else 0

    def pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        """Normalised stretches between special tokens, and those tokens, marked."""
        if self._specials is None or not any(s in text for s in self.vocabulary.specials):
            yield normal(text), False
            return
        for i, part in enumerate(self._specials.split(text)):
            if part:
                yield (part, True) if i % 2 else (normal(part), False)

    def total(self, text: str) -> int:
        tables, total = self._tables, 0
        for piece, special in self.pieces(text):
            if special:
                total += 1
                continue
            for word in find(piece):
                known = tables.get(word)
                total += (known or self.word(word))[3]
        return total

    def prefixes(self, text: str) -> tuple[str, list[int], list[int]]:
        """The normalised text, and at each word's end the characters and tokens so far."""
        out, ends, totals, at, total = [], [], [], 0, 0
        for piece, special in self.pieces(text):
            if special:
                total += 1
                ends.append(at + len(piece))
                totals.append(total)
            else:
                for m in _WORDS.finditer(piece):
                    total += self.word(m.group())[3]
                    ends.append(at + m.end())
                    totals.append(total)
            out.append(piece)
            at += len(piece)
        return "".join(out), ends, totals

    def cut(self, text: str, budget: int) -> tuple[str, int]:
        """The longest prefix, in whole characters, of the normalised text within ``budget``, and its count.

        Cut inside a word, the next longer prefix may have fewer tokens; the longest prefix is
        looked for among the places of the first word that does not fit as a whole.
        """
        whole, ends, totals = self.prefixes(text)
        i = bisect_right(totals, budget)
        if i == len(totals):
            return whole, totals[-1] if totals else 0
        before = totals[i - 1] if i else 0
        start = ends[i - 1] if i else 0
        skipped = len(whole[start : ends[i]]) - len(whole[start : ends[i]].lstrip())
        word = whole[start + skipped : ends[i]]
        if word not in self.vocabulary.specials:
            for n in range(len(word) - 1, 0, -1):
                if before + (inner := self.inside(word, n)) <= budget:
                    return whole[: start + skipped + n], before + inner
        return whole[: start + skipped], before


#: The library's own rules, for characters that Python's tables know otherwise or not yet.
_NORMAL = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


def normal(text: str) -> str:
    """NFC and small letters, character by character; white space needs no change to be dropped."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _NORMAL.normalize_str(text)
    return text.lower()


def find(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WORDS.findall(text)
    return _LATIN_WORDS.findall(text)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _texts(column: pa.Array) -> list[str]:
    return [t.decode() for t in raw_texts(column)]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every whole text; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            totals = [counts.total(t) for t in _texts(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(totals, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = docs.select("doc_id", size.alias("n_bytes"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, normal, ends, totals``: the normalised text and the table at its words' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            found = [counts.prefixes(t) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()),
                 *(pa.array([f[i] for f in found], pa.list_(pa.int32())) for i in (1, 2))],
                names=["doc_id", "normal", "ends", "totals"],
            )

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, normal string, ends array<int>, totals array<int>")


def truncated(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """``doc_id, text, n_tokens``: normalised texts cut to at most ``budget`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in batches:
            found = [counts.cut(t, budget) for t in _texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())],
                names=["doc_id", "text", "n_tokens"],
            )

    ids = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {ids}, text string, n_tokens long")
