"""Language identification by a byte convolutional network.

Texts are cut into windows of fixed length. Bytes are embedded, filters of several widths run
over them, each filter's largest activation in the window is kept, and a softmax over those
gives the window's language. NumPy trains it on windows of labelled texts; a text's
probabilities are the means over its windows, weighted by their bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.rolling import raw_texts
from vitrine.llm.sampling import class_sample, fold

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DEPTH = 8
#: The bound of the training sample: documents of each language, and windows of one document.
PER_CLASS = 1_200
WINDOWS_EACH = 2
EPOCHS = 5
BATCH = 64
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"

_SPAN = max(WIDTHS)


@dataclass
class Network:
    labels: list[str]
    embed: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # _SPAN * DEPTH x all filters
    shift: np.ndarray
    out: np.ndarray
    out_shift: np.ndarray

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """Embedded bytes under a filter at every place of every window."""
        embedded = self.embed[windows]
        return sliding_window_view(embedded.reshape(len(windows), -1), _SPAN * DEPTH, axis=1)[:, ::DEPTH]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        flat = self.patches(windows).reshape(-1, _SPAN * DEPTH)
        return (flat @ self.filters).reshape(len(windows), -1, self.filters.shape[1]).max(axis=1) + self.shift

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = np.maximum(self.pooled(windows), 0) @ self.out + self.out_shift
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def cut(text: bytes) -> np.ndarray:
    """All windows of a text, one after the other, the last one padded with zero bytes.

    Each also holds the first bytes of the next, so no place under a filter is lost.
    """
    n = max(1, -(-len(text) // WINDOW))
    padded = np.zeros(n * WINDOW + _SPAN - 1, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return sliding_window_view(padded, WINDOW + _SPAN - 1)[::WINDOW]


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], epochs: int = EPOCHS) -> Network:
    """Adam on the cross-entropy; only the places that won the pooling get a gradient."""
    rng = np.random.default_rng(7)
    total = FILTERS * len(WIDTHS)
    mask = np.zeros((_SPAN * DEPTH, total), np.float32)
    for i, width in enumerate(WIDTHS):
        mask[: width * DEPTH, i * FILTERS : (i + 1) * FILTERS] = 1
    net = Network(
        names,
        rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32),
        (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
        np.zeros(total, np.float32),
        rng.normal(0, 0.2, (total, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    parts = [net.embed, net.filters, net.shift, net.out, net.out_shift]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for s in range(0, len(order), BATCH):
            chosen = order[s : s + BATCH]
            x, y = windows[chosen], labels[chosen]
            patches = net.patches(x)
            scores = (patches.reshape(-1, _SPAN * DEPTH) @ net.filters).reshape(len(x), -1, total)
            place = scores.argmax(axis=1)
            pooled = np.take_along_axis(scores, place[:, None, :], 1)[:, 0] + net.shift
            active = np.maximum(pooled, 0)
            logits = active @ net.out + net.out_shift
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (pooled > 0)
            won = patches[np.arange(len(x))[:, None], place]
            d_filters = np.einsum("bf,bfk->kf", back, won) * mask
            d_patch = (back[:, :, None] * net.filters.T[None]).reshape(len(x), total, _SPAN, DEPTH)
            seen = x[np.arange(len(x))[:, None, None], place[:, :, None] + np.arange(_SPAN)]
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, seen.ravel(), d_patch.reshape(-1, DEPTH))
            grads = [d_embed, d_filters, back.sum(axis=0), active.T @ p, p.sum(axis=0)]
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for part, grad, (m, v) in zip(parts, grads, moments):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                part -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def _windows_of_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, labels, out = [], [], []
        for doc_id, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw_texts(batch.column(2))):
            windows = cut(text)
            start = zlib.crc32(text[:WINDOW]) % len(windows)
            for i in range(min(WINDOWS_EACH, len(windows))):
                ids.append(f"{doc_id}/{i}")
                labels.append(label)
                out.append(windows[(start + i * len(windows) // WINDOWS_EACH) % len(windows)].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.string()), pa.array(labels, pa.string()), pa.array(out, pa.binary())], names=["place", "lang", "bytes"]
        )


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> Network | None:
    """A network from a bounded sample of labelled texts outside the held-out fold.

    The sample holds about ``per_class`` documents of each language with ``WINDOWS_EACH``
    windows of each. Rows without a label or text teach nothing; without any, there is none.
    """
    known = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").filter(fold("doc_id", FOLDS) != HELD_FOLD)
    sample, _ = class_sample(known, "lang", "doc_id", per_class)
    rows = sample.mapInArrow(_windows_of_sample, "place string, lang string, bytes binary").toArrow()
    if not len(rows):
        return None
    rows = rows.sort_by([("place", "ascending"), ("bytes", "ascending")])
    names, labels = np.unique(np.array(rows["lang"].to_pylist()), return_inverse=True)
    windows = np.frombuffer(b"".join(rows["bytes"].to_pylist()), np.uint8).reshape(len(rows), -1)
    return train(windows, labels, [str(n) for n in names])


def _predict(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, letters = raw_texts(batch.column(2)), batch.column(1).to_pylist()
            sums, held, owners, sizes = np.zeros((len(texts), len(net.labels))), [], [], []

            def flush() -> None:
                if held:
                    p = net.probabilities(np.concatenate(held))
                    np.add.at(sums, owners, p * np.array(sizes)[:, None])
                    held.clear(), owners.clear(), sizes.clear()

            for i, text in enumerate(texts):
                if not letters[i]:
                    continue
                windows = cut(text)
                for s in range(0, len(windows), BATCH):
                    part = windows[s : s + BATCH]
                    held.append(part)
                    owners.extend([i] * len(part))
                    sizes.extend(min(WINDOW, len(text) - (s + k) * WINDOW) for k in range(len(part)))
                    if len(owners) >= BATCH:
                        flush()
            flush()
            best = sums.argmax(axis=1)
            total = np.maximum(sums.sum(axis=1), 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0),
                 pa.array([net.labels[b] if ok else UNKNOWN for b, ok in zip(best, letters)], pa.string()),
                 pa.array(np.where(letters, np.minimum(sums.max(axis=1) / total, 1.0), 0.0))],
                names=["doc_id", "lang_pred", "score"],
            )

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every whole text.

    A null text, or one without a letter, is ``und`` with score 0, as is every text without a
    network. Equal probabilities go to the label that sorts first. Only the text is looked at.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        found = docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        rows = docs.select("doc_id", known.alias("known"), "text")
        found = rows.mapInArrow(_predict(net), f"doc_id {ids}, lang_pred string, score double")
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_FOLD, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
