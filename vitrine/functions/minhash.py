"""MinHash band keys of token sets (part of O-39).

Tokens are integers, such as dimension numbers; texts can be hashed to 64 bits first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.vectors import matrix

# The permutation count, and the bands and rows per band of ``band_layout``
# at threshold 0.9.
PERMUTATIONS, BANDS, ROWS = 128, 5, 25
_ROWS_AT_ONCE = 2000


def band_layout(threshold: float, permutations: int = PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows per band with the least sum of false positives and false negatives.

    With ``b`` bands of ``r`` rows, sets of similarity ``s`` meet with probability
    ``1 - (1 - s^r)^b``. Wrong meetings lie below the threshold, missed ones above it.
    """
    s = (np.arange(1000) + 0.5) / 1000
    below = s < threshold

    def error(layout):
        bands, rows = layout
        meet = 1 - (1 - s**rows) ** bands
        return meet[below].sum() + (1 - meet[~below]).sum()

    layouts = [(b, r) for b in range(1, permutations + 1) for r in range(1, permutations // b + 1)]
    return min(layouts, key=error)


class BandHasher:
    """Seeded permutations of 64-bit values and the keys of the signature's bands."""

    def __init__(self, permutations: int, bands: int, rows: int, seed: int):
        if bands * rows > permutations:
            raise ValueError("bands * rows must not exceed the number of permutations")
        draw = np.random.default_rng(seed).integers(0, 2**64, (2, permutations), dtype=np.uint64)
        self.factors, self.offsets = draw[0] | np.uint64(1), draw[1]
        self.bands, self.rows = bands, rows

    def permuted(self, tokens: np.ndarray, p: int) -> np.ndarray:
        """Token hashes under permutation ``p``."""
        x = tokens.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        return x * self.factors[p] + self.offsets[p]

    def combine(self, lowest_of, count: int) -> np.ndarray:
        """``count`` rows of band keys; ``lowest_of(p)`` gives the minima of permutation ``p``.

        The band number is hashed in, so keys of different bands never meet.
        """
        keys = np.empty((count, self.bands), dtype=np.uint64)
        for band in range(self.bands):
            key = np.full(count, band + 1, dtype=np.uint64)
            for p in range(band * self.rows, (band + 1) * self.rows):
                key = (key ^ lowest_of(p)) * np.uint64(0x94D049BB133111EB)
                key ^= key >> np.uint64(29)
            keys[:, band] = key
        return keys.view(np.int64)


def _list_array(keys: np.ndarray, filled: np.ndarray) -> pa.Array:
    """Rows of keys as an Arrow list array, NULL where ``filled`` is false."""
    offsets = np.concatenate(([0], np.cumsum(filled) * keys.shape[1])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel()))
    return pa.compute.if_else(pa.array(filled), lists, pa.scalar(None, lists.type))


def band_keys(
    tokens: Column,
    permutations: int = PERMUTATIONS,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 1,
) -> Column:
    """One 64-bit key per band of the MinHash signature of an integer token set.

    Two rows share the key of a band when all ``rows`` minima of that band agree. NULL for
    no tokens.
    """
    hasher = BandHasher(permutations, bands, rows, seed)

    @F.arrow_udf("array<long>")
    def keys(sets: pa.Array) -> pa.Array:
        lengths = pa.compute.list_value_length(sets).fill_null(0).to_numpy()
        filled = lengths > 0
        flat = sets.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(lengths[filled]) - lengths[filled]

        def lowest_of(p):
            return np.minimum.reduceat(hasher.permuted(flat, p), starts)

        count = int(filled.sum())
        found = hasher.combine(lowest_of, count) if count else np.empty((0, bands), np.int64)
        return _list_array(found, filled)

    return keys(tokens.cast("array<long>"))


def vector_band_keys(
    vector: Column,
    top_m: int,
    permutations: int = PERMUTATIONS,
    bands: int = BANDS,
    rows: int = ROWS,
    seed: int = 1,
) -> Column:
    """``band_keys(top_dims(vector, top_m))`` in one Arrow step.

    Dimension numbers are few, so every permutation is a table lookup. All vectors of a
    batch must have one length; NULL for a NULL or empty vector.
    """
    hasher = BandHasher(permutations, bands, rows, seed)

    @F.arrow_udf("array<long>")
    def keys(vectors: pa.Array) -> pa.Array:
        lengths = pa.compute.list_value_length(vectors).fill_null(0).to_numpy()
        filled = lengths > 0
        m = matrix(vectors.filter(pa.array(filled)))
        width = m.shape[1]
        tables = [hasher.permuted(np.arange(width), p) for p in range(bands * rows)]
        parts = [np.empty((0, bands), np.int64)]
        for start in range(0, len(m), _ROWS_AT_ONCE):
            chunk = m[start : start + _ROWS_AT_ONCE]
            # Stable order of the reversed columns: largest first, ties to the higher index.
            order = np.argsort(-chunk[:, ::-1], axis=1, kind="stable")[:, :top_m]
            dims = np.ascontiguousarray((width - 1 - order).T)
            parts.append(hasher.combine(lambda p: tables[p][dims].min(axis=0), len(chunk)))
        return _list_array(np.concatenate(parts), filled)

    return keys(vector)
