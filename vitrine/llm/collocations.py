"""Collocations: phrases whose words stand together more often than their parts make likely.

Texts become sequences of word hashes, in which a break stands between pieces. Phrases are
counted level by level, as in Apriori: a phrase can only be frequent if the phrases of one word
less in it are. Which phrases may be frequent is told by bitmaps of bounded size: counts of whole
phrase hashes are added up by ranges, and a hash that reaches the least count sets its bit, so
none is missed. The candidates the bitmap lets through are dealt by ranges of hashes with their
counts in a batch. The task of a range makes them distinct, builds double-array tries of a bounded
number of them, and lets all phrases dealt to it step through a trie together: a level is one
addition, one look-up and one comparison for all phrases still on a path. So a level reads the
texts twice, however many phrases are frequent.

No task gathers a language, a word or a phrase: words are counted by partial aggregation,
candidates are dealt to tries by the hash of the whole phrase, and the best phrases of a language
are chosen per part before they meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.llm.rolling import Words, chunks, find_words, mix, raw_texts
from vitrine.llm.tables import few_rows
from vitrine.session import stage

LEAST, LONGEST, CONTAINED = 10, 3, 50
#: Candidates of one trie, and bits of a bitmap at most (16 MiB), which is broadcast.
TRIE_PHRASES, MAX_BITS = 500_000, 27
#: Bits of a line of a bitmap, as a power of two.
LINE_BITS = 9
#: Words that a task counts before it sends the counts, and rows that it sends at once.
BATCH_WORDS = 2_000_000
SENT_ROWS = 1 << 16

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_BREAK = np.zeros(256, bool)
_BREAK[list(_BREAKS)] = True
_WORD = ~_BREAK
_WORD[list(b" \t")] = False
_NONE = "und"


def _sliced(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size, as Spark holds each batch outside its heap."""
    whole = pa.RecordBatch.from_arrays(columns, names=names)
    for start in range(0, len(whole), SENT_ROWS):
        yield whole.slice(start, SENT_ROWS)


def word_sequences(texts: list[bytes]) -> tuple[Words, list[np.ndarray]]:
    """The words of texts, and each text as hashes of its words in order; a break is 0, and one ends a text."""
    words = find_words(texts, _WORD, lower=True)
    words.hashes[words.hashes == 0] = 1
    raw = np.frombuffer(words.data, np.uint8)
    begins = _BREAK[raw]
    begins[words.starts] = True
    places = np.r_[np.flatnonzero(begins), len(raw)]
    sequence = np.zeros(len(places), np.uint64)
    sequence[:-1][_WORD[raw[places[:-1]]]] = words.hashes
    # the line end between two texts is the break that ends the first
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.split(sequence, np.searchsorted(places, ends[:-1]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sequences of hashes by language (with ``words``, compressed) and counts of words (with ``word``)."""
    held, spelled, total = {}, [], 0
    names = ["lang", "words", "hash", "word", "n"]
    kinds = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def counted() -> Iterator[pa.RecordBatch]:
        if not total:
            return
        every, first = np.unique(np.concatenate([h for h, _ in spelled]), return_index=True)
        texts = [w for _, words in spelled for w in words]
        for lang, parts in held.items():
            hashes, n = np.unique(np.concatenate(parts), return_counts=True)
            word = pa.array([texts[i] for i in first[np.searchsorted(every, hashes)].tolist()], pa.binary()).cast(pa.string())
            columns = [pa.array([lang] * len(hashes), pa.string()), pa.nulls(len(hashes), pa.binary()), pa.array(hashes.view(np.int64)), word]
            yield from _sliced([*columns, pa.array(n.astype(np.int64))], names)

    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), raw_texts(batch.column(1))
        for s, e in chunks(texts):
            found, sequences = word_sequences(texts[s:e])
            own: dict[str, list] = {}
            for lang, sequence in zip(langs[s:e], sequences):
                own.setdefault(_NONE if lang is None else lang, []).append(sequence)
            packed = {lang: np.concatenate(parts) for lang, parts in own.items()}
            values = [list(packed), [zstandard.compress(w.tobytes(), 1) for w in packed.values()], *[[None] * len(packed)] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)
            for lang, words in packed.items():
                held.setdefault(lang, []).append(words[words != 0])
            hashes, first = np.unique(found.hashes, return_index=True)
            spans = zip(found.starts[first].tolist(), found.ends[first].tolist())
            spelled.append((hashes, [found.data[i:j] for i, j in spans]))
            total += len(found.hashes)
            if total >= BATCH_WORDS:
                yield from counted()
                held, spelled, total = {}, [], 0
    yield from counted()


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def _mixed(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(total * np.uint64(0xD6E8FEB86659FD93) + words)


def phrase_hashes(lang: str, words: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from every position on; positions too near a break give junk."""
    total = np.full(max(len(words) - size + 1, 0), _seed(lang), np.uint64)
    for k in range(size):
        total = _mixed(total, words[k : k + len(total)])
    return total


def _whole(words: np.ndarray, size: int) -> np.ndarray:
    """Positions from which ``size`` words follow without a break."""
    inside = words != 0
    n = max(len(words) - size + 1, 0)
    return reduce(np.logical_and, [inside[k : k + n] for k in range(size)]) if n else np.zeros(0, bool)


def _places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of hashes in a bitmap of ``2 ** bits``, both in one line."""
    at = hashes & np.uint64((1 << bits) - 1)
    return at, (at >> np.uint64(LINE_BITS) << np.uint64(LINE_BITS)) | (hashes >> np.uint64(64 - LINE_BITS))


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of hashes are set."""
    one, other = ((bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                  for at in _places(hashes, len(bits).bit_length() + 2))
    return one & other


def _open(lang: str, words: np.ndarray, size: int, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the phrases whose parts of one word less may all be frequent."""
    shorter = phrase_hashes(lang, words, size - 1)
    likely = _set(below, shorter)
    n = max(len(words) - size + 1, 0)
    at = np.flatnonzero(_whole(words, size) & likely[:n] & likely[1 : n + 1]) if n else np.zeros(0, np.int64)
    return at, _mixed(shorter[at], words[at + (size - 1)])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    for batch in batches:
        for lang, words in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield lang, np.frombuffer(zstandard.decompress(words.as_buffer()), np.uint64)


#: Buckets of phrases whose counts travel as one row, as a power of two.
BUCKET_BLOCK = 16
#: Blocks whose sums one task holds at most.
HELD_BLOCKS = 32


def pack_counts(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending numbers of up to 64 bits and their counts, as gaps and counts byte by byte, compressed."""
    columns = np.diff(places.astype("<u8"), prepend=np.uint64(0)), counts.astype("<u8")
    return zstandard.compress(b"".join(c.view(np.uint8).reshape(len(c), -1).T.tobytes() for c in columns), 1)


def unpack_counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(16, -1)
    gaps, counts = (np.ascontiguousarray(raw[rows].T).view("<u8")[:, 0] for rows in (slice(8), slice(8, 16)))
    return np.cumsum(gaps, dtype=np.uint64), counts.astype(np.int64)


def _block_rows(numbers: np.ndarray, counts: np.ndarray, power: int) -> Iterator[pa.RecordBatch]:
    """Counts of ascending numbers as ``block, counts`` rows."""
    numbers = numbers.astype(np.int64)
    blocks, start = np.unique(numbers >> power, return_index=True)
    ends = np.r_[start[1:], len(numbers)]
    packed = [pack_counts(numbers[s:e] & ((1 << power) - 1), counts[s:e]) for s, e in zip(start.tolist(), ends.tolist())]
    yield from _sliced([pa.array(blocks.astype(np.int32)), pa.array(packed, pa.binary())], ["block", "counts"])


def _block_sums(batches: Iterator[pa.RecordBatch], power: int, most: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Counts by place of each block in a task, added up row by row; with ``most`` no sum goes beyond it."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            places, counts = unpack_counts(data)
            if block not in held:
                held[block] = np.zeros(1 << power, np.int64 if most is None else np.int32)
            total = held[block][places] + counts
            held[block][places] = total if most is None else np.minimum(total, most)
    yield from held.items()


def _by_block(rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of counts dealt so that a task meets all of a block, and few blocks."""
    usual = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(min(blocks, max(-(-blocks // HELD_BLOCKS), usual)), "block")


def _bucket_rows(held: list[np.ndarray], most: int) -> Iterator[pa.RecordBatch]:
    """Counts of buckets, none beyond ``most``."""
    if held:
        bucket, n = np.unique(np.concatenate(held), return_counts=True)
        yield from _block_rows(bucket, np.minimum(n, most), BUCKET_BLOCK)


def _counted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ascending ``keys`` and how many there are of each."""
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[start], np.diff(np.r_[start, len(keys)])


def _turned(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes with the bits that tell the place in a bitmap put first, so that their order is that of the places."""
    return (hashes << np.uint64(64 - bits)) | (hashes >> np.uint64(bits))


def _phrase_counts(size: int, below, bits: int, power: int, most: int):
    """How many phrases of a task have each hash, as far as ``most``; those of one of ``2 ** power`` slices of the bitmap as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            keys, n = _counted_runs(np.sort(np.concatenate(held)))
            own, start = np.unique(keys >> np.uint64(64 - power), return_index=True)
            ends = np.r_[start[1:], len(keys)]
            packed = [pack_counts(keys[s:e], np.minimum(n[s:e], most)) for s, e in zip(start.tolist(), ends.tolist())]
            yield from _sliced([pa.array(own.astype(np.int32)), pa.array(packed, pa.binary())], ["part", "counts"])

        for lang, words in _texts(batches):
            _, hashes = _open(lang, words, size, below.value)
            held.append(_turned(hashes, bits))
            total += len(hashes)
            if total >= BATCH_WORDS:
                yield from sent()
                held, total = [], 0
        if held:
            yield from sent()

    return run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """The rows of a task by their first column, which is in order."""
    rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns)))
    return groupby(rows, key=lambda row: row[0])


def _by_part(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows dealt so that a task meets all of a part, one part after the other."""
    return rows.repartition(tasks, "part").sortWithinPartitions("part")


def sum_counts(held: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts, as far as ``most``."""
    keys, counts = (np.concatenate(columns) for columns in zip(*held))
    order = np.argsort(keys)
    keys, n = _counted_runs(keys[order])
    start = np.cumsum(n) - n
    return keys, np.minimum(np.add.reduceat(counts[order], start), most) if len(keys) else counts


def _crowded_hashes(bits: int, power: int, least: int):
    """The slices of the bitmap a task has: the bits of hashes whose counts reach ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _parts(batches):
            held, kept, fresh = [], 0, 0
            for _, data in rows:
                held.append(unpack_counts(data))
                fresh += len(held[-1][0])
                if fresh > max(kept, BATCH_WORDS // 4):
                    held = [sum_counts(held, least)]
                    kept, fresh = len(held[0][0]), 0
            keys, counts = sum_counts(held, least)
            marks = np.zeros(1 << (bits - power), bool)
            for place in _places(_turned(keys[counts >= least], 64 - bits), bits):
                marks[place & np.uint64(len(marks) - 1)] = True
            packed = np.packbits(marks, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bits"])

    return run


#: Words of the corpus for each task that counts phrases; it has two parts of them on average.
RANGE_WORDS = 1 << 23


def pack_phrases(words: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows of word hashes and their counts below 2 ** 32, column by column and counts byte by byte, compressed."""
    return zstandard.compress(words.T.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack_phrases(data: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(data)
    n = len(raw) // (8 * size + 4)
    counts = np.frombuffer(raw, np.uint8, offset=8 * size * n).reshape(4, -1)
    return np.frombuffer(raw, np.uint64, size * n).reshape(size, -1).T, np.ascontiguousarray(counts.T).view("<u4")[:, 0].astype(np.int64)


def _candidates(size: int, below, own, parts: int):
    """The phrases that may be frequent, distinct within a batch of a task, and their counts there; those of a part as one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = {}, 0

        def sent() -> Iterator[pa.RecordBatch]:
            found = []
            for number, pieces in enumerate(held.values()):
                hashes, first, n = np.unique(np.concatenate([p[0] for p in pieces]), return_index=True, return_counts=True)
                words = np.concatenate([p[1] for p in pieces])[first]
                part = ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
                found.append((part, np.full(len(part), number), words, n))
            part, lang, words, n = (np.concatenate(columns) for columns in zip(*found))
            # equal words side by side compress
            order = np.lexsort((words[:, 0], lang, part))
            part, lang, words, n = part[order], lang[order], words[order], n[order]
            own_parts, start = np.unique(part, return_index=True)
            names = np.array(list(held), object)
            langs, sizes, packed = [], [], []
            for s, e in zip(start.tolist(), np.r_[start[1:], len(part)].tolist()):
                numbers, many = _counted_runs(lang[s:e])
                langs.append(names[numbers].tolist())
                sizes.append(many.tolist())
                packed.append(pack_phrases(words[s:e], n[s:e]))
            columns = [pa.array(own_parts), pa.array(langs, pa.list_(pa.string())), pa.array(sizes, pa.list_(pa.int32())), pa.array(packed, pa.binary())]
            yield from _sliced(columns, ["part", "langs", "sizes", "phrases"])

        for lang, words in _texts(batches):
            at, hashes = _open(lang, words, size, below.value)
            stay = _set(own.value, hashes)
            at, hashes = at[stay], hashes[stay]
            held.setdefault(lang, []).append((hashes, words[at[:, None] + np.arange(size)]))
            total += len(at)
            if total >= BATCH_WORDS // 2:
                yield from sent()
                held, total = {}, 0
        if held:
            yield from sent()

    return run


def distinct_rows(parts: list[np.ndarray]) -> np.ndarray:
    rows = np.concatenate(parts)
    rows = rows[np.lexsort(rows.T[::-1])]
    return rows[np.r_[True, (rows[1:] != rows[:-1]).any(1)][: len(rows)]]


def _by_lang(row: tuple, size: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """The phrases of a row of candidates and their counts, language by language."""
    words, counts = unpack_phrases(row[3], size)
    ends = np.cumsum(row[2])[:-1]
    yield from zip(row[1], np.split(words, ends), np.split(counts, ends))


def distinct_phrases(rows: list[tuple], size: int) -> tuple[list[str], np.ndarray]:
    """The languages and words of the distinct phrases of rows of candidates."""
    held: dict[str, list[np.ndarray]] = {}
    kept = fresh = 0
    for row in rows:
        for lang, words, _ in _by_lang(row, size):
            held.setdefault(lang, []).append(words)
            fresh += len(words)
        if fresh > max(kept, BATCH_WORDS // 4):
            held = {lang: [distinct_rows(parts)] for lang, parts in held.items()}
            kept, fresh = sum(len(parts[0]) for parts in held.values()), 0
    found = {lang: distinct_rows(parts) for lang, parts in held.items()}
    return [lang for lang, words in found.items() for _ in range(len(words))], np.concatenate(list(found.values()))


@dataclass
class Trie:
    """A double array: state ``s`` goes with digit ``d`` to ``base[s] + d`` if ``check`` there is ``s``.

    A word is two digits of its place in ``alphabet``, from 1, so that no state has more than
    ``radix`` children. ``roots`` has the state of each language, ``accepts`` the number of the
    phrase that ends in a state, or -1.
    """

    alphabet: np.ndarray
    radix: int
    roots: dict[str, int]
    base: np.ndarray
    check: np.ndarray
    accepts: np.ndarray
    langs: list[str]
    words: np.ndarray

    def digits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both digits of words, 0 for those the trie does not have and for breaks."""
        place = np.minimum(np.searchsorted(self.alphabet, words), len(self.alphabet) - 1)
        known = self.alphabet[place] == words
        return np.where(known, place // self.radix + 1, 0), np.where(known, place % self.radix + 1, 0)

    def step(self, states: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where none does."""
        to = self.base[states] + digits
        return np.where((digits > 0) & (self.check[to] == states), to, -1)

    def accepted(self, lang: str, words: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """States in which phrases end, one for each occurrence; all positions ``at`` step together."""
        size = self.words.shape[1]
        root = self.roots.get(lang)
        if root is None or len(words) < size:
            return np.zeros(0, np.int64)
        at = np.arange(len(words) - size + 1) if at is None else at
        states = np.full(len(at), root, np.int64)
        digits = self.digits(words)
        for k in range(size):
            for digit in digits:
                states = self.step(states, digit[at + k])
                alive = states >= 0
                at, states = at[alive], states[alive]
        return states


#: Random places that a state with several children tries before it is put behind all others.
_TRIES = 6


def build_trie(langs: list[str], words: np.ndarray, seed: int = 0) -> Trie:
    """The trie of distinct phrases, given as rows of word hashes with their languages.

    States with several children, those with most first, look for a free place at random, then
    behind all others; states with one child take the places that stay free.
    """
    n, size = words.shape
    alphabet = np.unique(words)
    places = np.searchsorted(alphabet, words)
    radix = int(np.ceil(np.sqrt(len(alphabet)))) + 1
    names = sorted(set(langs))
    roots = {name: i for i, name in enumerate(names)}
    span = radix + 2
    room = tail = len(names) + 2 * n
    used = np.zeros(room + span, bool)
    used[: len(names)] = True
    moves = []
    rng = np.random.default_rng(seed)
    states = np.array([roots[x] for x in langs], np.int64)
    for k in range(2 * size):
        digit = (places[:, k // 2] // radix if k % 2 == 0 else places[:, k // 2] % radix) + 1
        edges, at = np.unique(states * span + digit, return_inverse=True)
        state, code = edges // span, edges % span
        start = np.flatnonzero(np.r_[True, state[1:] != state[:-1]])
        many = np.diff(np.r_[start, len(edges)])
        to = np.full(len(edges), -1, np.int64)
        for i in np.argsort(-many, kind="stable")[: int((many > 1).sum())]:
            s, e = start[i], start[i] + many[i]
            steps = code[s:e] - code[s]
            for slot in rng.integers(room - span, size=_TRIES).tolist() if many[i] < 32 and room > span else ():
                if not used[steps + slot].any():
                    break
            else:
                slot = tail
                tail += int(steps[-1]) + 1
                if tail + span > len(used):
                    used = np.r_[used, np.zeros(len(used) + span, bool)]
            to[s:e] = steps + slot
            used[to[s:e]] = True
        single = start[many == 1]
        free = np.flatnonzero(~used[:tail])[: len(single)]
        if len(free) < len(single):
            more = len(single) - len(free)
            free = np.r_[free, np.arange(tail, tail + more)]
            tail += more
            used = np.r_[used, np.zeros(max(0, tail + span - len(used)), bool)]
        to[single] = free
        used[free] = True
        moves.append((state, to, code))
        states = to[at]
    base, check = np.zeros(tail + 2 * span, np.int32), np.full(tail + 2 * span, -1, np.int32)
    for state, to, code in moves:
        base[state], check[to] = to - code, state
    accepts = np.full(len(base), -1, np.int32)
    accepts[states] = np.arange(n)
    return Trie(alphabet, radix, roots, base, check, accepts, langs, words)


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    """Which trie has a phrase, by the hashes of its words."""
    return reduce(np.bitwise_xor, [w.view(np.int64) >> (7 * k) for k, w in enumerate(np.ascontiguousarray(words.T))]) % shards


def count_phrases(rows: list[tuple], size: int, most: int) -> Iterator[tuple[Trie, np.ndarray]]:
    """Tries of about ``most`` phrases each, one after the other, that have all phrases of rows of candidates.

    With each come the sums of the counts by the numbers of its phrases.
    """
    langs, phrases = distinct_phrases(rows, size)
    shards = -(-len(phrases) // most) or 1
    shard = _shard(phrases, shards)
    for i in range(shards):
        own = np.flatnonzero(shard == i)
        if not len(own):
            continue
        trie = build_trie([langs[k] for k in own.tolist()], phrases[own])
        total = np.zeros(len(own), np.int64)
        for row in rows:
            for lang, words, counts in _by_lang(row, size):
                mine = np.flatnonzero(_shard(words, shards) == i)
                states = trie.accepted(lang, words[mine].reshape(-1), np.arange(len(mine)) * size)
                np.add.at(total, trie.accepts[states], counts[mine])
        yield trie, total


def _frequent(size: int, least: int, most: int):
    """The phrases whose counts reach ``least`` in all, from the rows of candidates a task has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _parts(batches):
            for trie, total in count_phrases(list(rows), size, most):
                number = np.flatnonzero(total >= least)
                words = trie.words[number].view(np.int64)
                columns = [pa.array(np.ascontiguousarray(words[:, k])) for k in range(size)]
                lang = pa.array([trie.langs[i] for i in number.tolist()], pa.string())
                yield from _sliced([lang, *columns, pa.array(total[number])], ["lang", *_columns(size), "f"])

    return run


def _crowded(least: int):
    """The places of a block whose counts reach ``least``, as bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, total in _block_sums(batches, BUCKET_BLOCK, least):
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits], pa.binary())], names=["block", "bits"])

    return run


def bitmap(counts: DataFrame, bits: int, least: int) -> np.ndarray:
    """Buckets that reach ``least``, from ``block, counts`` rows: at most ``2 ** MAX_BITS`` bits, packed in tasks."""
    return _joined(_by_block(counts, 1 << (bits - BUCKET_BLOCK)).mapInArrow(_crowded(least), "block int, bits binary"), bits)


def _joined(blocks: DataFrame, bits: int) -> np.ndarray:
    """The bitmap whose blocks of one size are rows."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in blocks.collect():
        own = np.frombuffer(row["bits"], np.uint8)
        out[row["block"] * len(own) : (row["block"] + 1) * len(own)] = own
    return out


def _hashed(size: int, bits: int):
    """Buckets of phrases given as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names, lang = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            words = [batch.column(1 + k).to_numpy().view(np.uint64) for k in range(size)]
            bucket = np.zeros((2, len(lang)), np.int64)
            for i, name in enumerate(names):
                own = lang == i
                total = np.full(int(own.sum()), _seed(name), np.uint64)
                for w in words:
                    total = _mixed(total, w[own])
                bucket[:, own] = _places(total, bits)
            yield from _bucket_rows([bucket.reshape(-1)] if bucket.size else [], 1)

    return run


#: Rows of an Arrow batch, which Spark holds outside its heap: texts, and sequences of up to half a megabyte of text.
TEXT_ROWS, SEQUENCE_ROWS = 1_000, 16


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is run inside gets Arrow batches of at most so many rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _columns(size: int, first: int = 0) -> list[str]:
    return [f"w{k}" for k in range(first, first + size)]


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Words and frequent phrases of ``lang, text`` rows.

    Returns ``lang, hash, word, n`` of all words, and for sizes 1 to ``longest`` the phrases of
    at least ``least`` occurrences, ``lang, w0, w1, ..., f``, words as hashes of 64 bits.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    with arrow_rows(spark, TEXT_ROWS):
        read = stage(rows.mapInArrow(_read, "lang string, words binary, hash long, word string, n long"), "read")
    texts = read.filter("words IS NOT NULL").select("lang", "words")
    words = stage(read.filter("hash IS NOT NULL").groupBy("lang", "hash").agg(F.first("word").alias("word"), F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    bits = min(MAX_BITS, max(BUCKET_BLOCK, (total // 4).bit_length()))
    found = [words.filter(F.col("n") >= least).select("lang", F.col("hash").alias("w0"), F.col("n").alias("f"))]
    tasks = max(-(-total // RANGE_WORDS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 64))
    power = min((2 * tasks - 1).bit_length(), bits - LINE_BITS)
    hashed = found[0].select("lang", "w0").mapInArrow(_hashed(1, bits), "block int, counts binary")
    below = spark.sparkContext.broadcast(bitmap(hashed, bits, 1))
    for size in range(2, longest + 1):
        schema = ", ".join(["lang string", *(f"{c} long" for c in _columns(size)), "f long"])
        with arrow_rows(spark, SEQUENCE_ROWS):
            counts = texts.mapInArrow(_phrase_counts(size, below, bits, power, least), "part int, counts binary")
            crowded = _by_part(counts, tasks).mapInArrow(_crowded_hashes(bits, power, least), "block int, bits binary")
            own = spark.sparkContext.broadcast(_joined(crowded, bits))
            packed = texts.mapInArrow(_candidates(size, below, own, 2 * tasks), "part int, langs array<string>, sizes array<int>, phrases binary")
            found.append(stage(_by_part(packed, tasks).mapInArrow(_frequent(size, least, TRIE_PHRASES), schema), "phrases"))
        below.destroy()
        # the bits of frequent phrases: what is open one level up
        below = own
    below.destroy()
    return words, found


def _named(table: DataFrame, size: int, first: int, count: str) -> DataFrame:
    """A table of phrases under the names of the words from ``first`` on."""
    return table.toDF("lang", *_columns(size, first), count)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, contained: int = CONTAINED) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of the phrases of 2 to ``longest`` words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and into words at
    spaces and tabs. ``a``, at least ``least``, counts a phrase in its language, ``n`` all words.
    Of its cuts in two, found ``l`` and ``r`` times, the one with the lowest
    ``floor(1000000 * a * a / (l * r))`` counts, the first of equals; products are exact for
    counts below 10 ** 16. A phrase within a longer one that has at least ``contained`` percent of its count is
    left out. A null language is ``und``, a null or empty text has no words, repeated rows count
    again, other columns are left out, and an empty table gives no rows.
    """
    words, found = frequent_phrases(docs, least, longest)
    spelled = words.select("lang", "hash", "word")
    totals = few_rows(stage(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals"))
    wide = "cast({} as decimal(19, 0))".format
    parts = []
    for size in range(2, longest + 1):
        rows, columns = found[size - 1].withColumnRenamed("f", "a"), _columns(size)
        inner = [
            longer.select("lang", *(F.col(f"w{first + k}").alias(f"w{k}") for k in range(size)), "f")
            for extra, longer in enumerate(found[size:], 1) for first in range(extra + 1)
        ]
        if inner:
            over = reduce(DataFrame.union, inner).groupBy("lang", *columns).agg(F.max("f").alias("over"))
            rows = rows.join(over, ["lang", *columns], "left").filter(F.expr(f"over IS NULL OR 100 * over < {contained} * a")).drop("over")
        cuts = []
        for k in range(1, size):
            rows = rows.join(_named(found[k - 1], k, 0, f"l{k}"), ["lang", *_columns(k)])
            rows = rows.join(_named(found[size - k - 1], size - k, k, f"r{k}"), ["lang", *_columns(size - k, k)])
            score = f"(cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')}) div ({wide(f'l{k}')} * {wide(f'r{k}')})"
            cuts.append(F.struct(F.expr(score).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
        for k in range(size):
            rows = rows.join(spelled.toDF("lang", f"w{k}", f"word{k}"), ["lang", f"w{k}"])
        phrase = F.concat_ws(" ", *(f"word{k}" for k in range(size)))
        parts.append(rows.select("lang", phrase.alias("phrase"), F.lit(size).alias("size"), "a", "cut.l", "cut.r", "cut.score"))
    return reduce(DataFrame.union, parts).join(totals, "lang").select("lang", "phrase", "size", "a", "l", "r", "n", "score")


def best_of_each(found: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of each language by score, count and phrase, with their ``rank``.

    Languages are cut to ``limit`` in parts first, so no task sorts all of a language, however ``found`` is dealt.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
    few = found.withColumn("part", part).repartition("lang", "part").withColumn("rank", rank).filter(F.col("rank") <= limit).drop("part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)
