"""Toxicity by multiple-instance learning: documents are labelled, sentences are found.

A sentence's score is a logistic function of the weights of its words, and a document is toxic
unless none of its sentences is: ``1 - prod(1 - p)``, the noisy-or. Sentences without any word
that was learned are left out of it, or else every text would be toxic once long enough. The
weights are trained
on document labels alone; as a clean document pushes down all its sentences and a toxic one
pulls up those that explain the label, the sentences at fault can then be named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.rolling import ALNUM, chunks, find_words, raw_texts
from vitrine.llm.sampling import class_sample, fold
from vitrine.llm.tables import fresh

#: The bound of the training sample: documents of each label, and bytes of one document.
PER_CLASS = 3_000
SAMPLE_BYTES = 1 << 16
#: Beginnings of words, in bytes, that are features beside the whole words: insults inflect.
STEMS = range(4, 9)
#: A feature is a candidate if so many toxic documents of the sample hold it, and if it is so many
#: standard deviations more frequent there than chance would have it.
LEAST_DOCS, LEAST_LIFT = 4, 4.0
#: The weight every sentence starts from; those that could teach it are left out of the noisy-or.
BIAS = -6.0
EPOCHS = 150
RATE = 0.1
#: Weights of the sum of feature weights in the loss, a mean over documents: to choose features,
#: and to weigh the chosen ones; a feature is chosen by a weight above the last figure.
SPARSE = (2e-4, 1e-5)
LEAST_WEIGHT = 0.7
FOLDS, HELD_FOLD = 5, 0

_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?\n"]] = True


@dataclass
class Model:
    """Sorted feature hashes, their weights, and the weight every sentence starts from."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


#: What a sample without toxic documents teaches.
NOTHING = Model(np.zeros(0, np.uint64), np.zeros(0), BIAS)


@dataclass
class Sentences:
    """Features of the sentences of several texts; each sentence's text and first byte there."""

    hashes: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray

    def held(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places among the hashes of those in ``features``, which are sorted, and places there."""
        if not len(features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(features, self.hashes), len(features) - 1)
        held = np.flatnonzero(features[near] == self.hashes)
        return held, near[held]

    def margins(self, model: Model) -> np.ndarray:
        held, column = self.held(model.features)
        return np.bincount(self.sentence[held], model.weights[column], len(self.text)) + model.bias

    def scored(self, model: Model, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the ``n`` texts, and the sentences that alone reach one half."""
        z = self.margins(model)
        some = np.unique(self.sentence[self.held(model.features)[0]])
        return -np.expm1(-np.bincount(self.text[some], np.logaddexp(0, z[some]), n)), some[z[some] >= 0]


def sentences(texts: list[bytes]) -> Sentences:
    """Words and word beginnings between full stops, exclamation and question marks and line ends."""
    words = find_words(texts, ALNUM, lower=True)
    if not len(words.starts):
        return Sentences(words.hashes, *[np.zeros(0, np.int64)] * 3)
    stops = np.cumsum(_STOPS[np.frombuffer(words.data, np.uint8)])[words.starts]
    new = np.r_[True, stops[1:] != stops[:-1]]
    number = np.cumsum(new) - 1
    at, stems = words.prefixes(STEMS)
    owner = words.owner[new]
    bounds = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    return Sentences(np.r_[words.hashes, stems], np.r_[number, number[at]], owner, words.starts[new] - bounds[owner])


def _per_text(texts: list[bytes], known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Features, or those in ``known``, and how many of the texts hold each."""
    found = []
    for s, e in chunks(texts):
        own = sentences(texts[s:e])
        hashes, text = own.hashes, own.text[own.sentence]
        if known is not None:
            held = np.flatnonzero(np.isin(hashes, known))
            hashes, text = hashes[held], text[held]
        order = np.lexsort((text, hashes))
        h, t = hashes[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        found.append(h[new])
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _candidates(texts: list[bytes], labels: np.ndarray) -> np.ndarray:
    """Features that more toxic documents hold than chance would have it.

    Only features of enough toxic documents are counted in the others, which keeps this small.
    """
    filled = np.array([bool(t.strip()) for t in texts], bool)
    toxic = int(labels[filled].sum())
    if not toxic:
        return np.zeros(0, np.uint64)
    known, by_toxic = _per_text([t for t, y in zip(texts, labels) if y], None)
    enough = by_toxic >= LEAST_DOCS
    known, by_toxic = known[enough], by_toxic[enough]
    clean, by_clean = _per_text([t for t, y in zip(texts, labels) if not y], known)
    held = by_toxic.astype(float)
    held[np.searchsorted(known, clean)] += by_clean
    base = toxic / filled.sum()
    lift = (by_toxic - held * base) / np.sqrt(held * base * (1 - base) + 1e-9)
    return known[lift >= LEAST_LIFT]


def train(texts: list[bytes], labels: np.ndarray, class_weight: dict[int, float]) -> Model:
    """Fit the noisy-or of sentence scores to the labels of the documents."""
    known = _candidates(texts, labels)
    if not len(known):
        return NOTHING
    docs, sentence, column, n = [], [], [], 0
    for s, e in chunks(texts):
        own = sentences(texts[s:e])
        present, places = own.held(known)
        docs.append(own.text + s)
        sentence.append((own.sentence[present] + n).astype(np.int32))
        column.append(places.astype(np.int32))
        n += len(own.text)
    doc, sentence, column = (np.concatenate(x) for x in (docs, sentence, column))
    held = np.unique(doc)
    doc, y = np.searchsorted(held, doc), labels[held]
    weight = np.array([class_weight[int(v)] for v in y])
    weight = weight / weight.sum()
    # chosen under a strong penalty, then fitted anew under a weak one
    theta = np.zeros(len(known))
    for penalty in SPARSE:
        some, place = np.unique(sentence, return_inverse=True)
        theta = _descend(theta, place, column, doc[some], y, weight, penalty)
        keep = theta > LEAST_WEIGHT
        if not keep.any():
            return NOTHING
        place = np.cumsum(keep) - 1
        some = keep[column]
        sentence, column = sentence[some], place[column[some]]
        known, theta = known[keep], theta[keep]
    return Model(known, theta, BIAS)


def _descend(theta, sentence, column, doc, y, weight, penalty):
    """Proximal Adam on the noisy-or's log-loss with weights of at least zero.

    ``doc`` are the documents of the sentences that have a feature; others teach nothing.
    """
    m, v = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, EPOCHS + 1):
        z = np.bincount(sentence, theta[column], len(doc)) + BIAS
        soft = np.logaddexp(0, z)
        total = np.maximum(np.bincount(doc, soft, len(y)), 1e-12)
        slope = np.where(y == 1, -1 / np.expm1(np.minimum(total, 50)), 1.0) * weight
        dz = slope[doc] * np.exp(z - soft)
        grad = np.bincount(column, dz[sentence], len(theta))
        m = 0.8 * m + 0.2 * grad
        v = 0.98 * v + 0.02 * grad * grad
        rate = RATE / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
        theta = np.maximum(theta - rate * m / (1 - 0.8**step) - penalty * rate, 0)
    return theta


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from a bounded sample of labelled documents outside the held-out fold.

    The sample holds about ``per_class`` documents of each label and none of more than
    ``SAMPLE_BYTES`` bytes; each class weighs as much as it does among all labelled rows.
    Rows with a null label, id or text, and documents labelled both ways, teach nothing.
    """
    marked = (
        labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold("doc_id", FOLDS) != HELD_FOLD)
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    )
    sample, counts = class_sample(marked, "toxic", "doc_id", per_class)
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = rows["toxic"].to_numpy().astype(int)
    taken = np.bincount(y, minlength=2)
    weights = {c: counts[c] / max(taken[c], 1) for c in counts}
    return train(raw_texts(rows["text"].combine_chunks()), y, weights)


def _score(model: Model, place: int, added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw_texts(batch.column(place))
            scores, found = np.zeros(len(texts)), [[] for _ in texts]
            for s, e in chunks(texts):
                own = sentences(texts[s:e])
                scores[s:e], reached = own.scored(model, e - s)
                for i in reached:
                    text, at = texts[s + own.text[i]], own.start[i]
                    end = min([p for c in b".!?\n" if (p := text.find(bytes([c]), at)) >= 0], default=len(text))
                    found[s + own.text[i]].append(text[at:end])
            named = pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores), named], names=[*batch.schema.names, *added])

    return run


def with_toxicity(docs: DataFrame, model: Model, score: str = "score", found: str = "sentences") -> DataFrame:
    """``docs`` with the score of each whole text and the sentences that alone reach one half.

    Sentences end at full stops, exclamation and question marks and line ends. A text without
    a learned feature, as a null or empty one, scores 0. Rows are scored one by one, whatever their ids.
    """
    out = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(found, T.ArrayType(T.StringType()))])
    return docs.mapInArrow(_score(model, docs.columns.index("text"), [score, found]), out)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns."""
    score, found = fresh(docs, "score"), fresh(docs, "sentences")
    return with_toxicity(docs, fit(docs, labels), score, found).filter(F.col(score) < 0.5).drop(score, found)
