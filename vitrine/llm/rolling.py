"""Words and rolling hashes of many texts at once, as NumPy arrays.

The hashes are Rabin-Karp polynomials modulo 2**64 with odd multipliers, which have inverses,
so the hash of any span is a difference of two prefix sums times an inverse power, and one
vectorised pass serves all spans. Every hash is mixed at the end, so its bits are usable as
they are. Words of 512 bytes and more get a keyed digest instead, since polynomials modulo
2**64 have known collisions on long inputs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
LONG_WORD = 512
#: Bytes of text handled at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 19

#: Bytes that separate words: space and the five controls from tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Word bytes of the benchmark rule: digits, small letters and everything outside ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes.maketrans(UPPER, UPPER.lower())


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self._bases, self._tables = (base, inverse), [np.ones(1, np.uint64)] * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._tables[0]) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for i, base in enumerate(self._bases):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                self._tables[i] = np.cumprod(steps, dtype=np.uint64)
        return self._tables[0][:n], self._tables[1][:n]


_BYTES = Powers(BYTE_BASE)
_WORDS = tuple(Powers(base) for base in WORD_BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a hash: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, powers: Powers, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed polynomial hash of ``values[start:end]`` for every span."""
    up, down = powers.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


@dataclass
class Words:
    """Words of several texts: byte spans in ``data``, hashes, and each text's word range."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of text i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, width: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``width`` words within one text."""
        n = len(self.starts) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        owner = self.owner
        at = np.flatnonzero(owner[:n] == owner[width - 1 :])
        return at, span_hashes(self.hashes, _WORDS[which], at, at + width)

    def prefixes(self, lengths: range) -> tuple[np.ndarray, np.ndarray]:
        """Word number and hash of the first bytes of each word that has more of them."""
        size = self.ends - self.starts
        number = np.concatenate([np.flatnonzero(size > n) for n in lengths])
        cut = np.repeat(np.array(lengths), [int((size > n).sum()) for n in lengths])
        values = np.frombuffer(self.data, np.uint8).astype(np.uint64) + np.uint64(1)
        starts = self.starts[number]
        return number, mix(span_hashes(values, _BYTES, starts, starts + cut) + np.uint64(1))

    def whole(self, which: int = 0) -> np.ndarray:
        """Hash of each text's whole word sequence."""
        return span_hashes(self.hashes, _WORDS[which], self.first[:-1], self.first[1:])


def find_words(texts: list[bytes], word_bytes: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of ``word_bytes`` in each text; ``lower`` maps A-Z to a-z first."""
    data = b"\n".join(texts)
    if lower:
        data = data.translate(LOWER)
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = word_bytes[raw]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    hashes = span_hashes(raw.astype(np.uint64) + np.uint64(1), _BYTES, starts, ends)
    for i in np.flatnonzero(ends - starts >= LONG_WORD):
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return Words(data, starts, ends, hashes, np.searchsorted(starts, bounds))


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` bytes."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
