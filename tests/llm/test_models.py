"""Trained operators: held-out accuracy, use of the text alone, and odd rows."""

import random
import zlib

import numpy as np
import pytest

from vitrine.llm import langid, toxicity

SCHEMA = "doc_id long, text string, lang string"


def fold(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def written(rng, sounds, n):
    return " ".join("".join(rng.choice(sounds) for _ in range(rng.randrange(1, 4))) for _ in range(n))


SOUNDS = {"xa": ["th", "ing", "er", "ou", "ly"], "xb": ["ü", "ch", "ge", "ver", "ß"], "xc": ["ción", "ñ", "lla", "ar", "os"]}


@pytest.fixture(scope="module")
def languages(spark):
    rng = random.Random(2)
    rows = [(i, written(rng, SOUNDS[lang], rng.choice([8, 40, 300])), lang) for i in range(900) for lang in [rng.choice(list(SOUNDS))]]
    rows += [(1000, None, "xa"), (1001, "", "xa"), (1002, "12 ?! 3", "xb"), (1003, "ching chching ver" * 2000, None)]
    return rows


def test_language_of_held_out_texts(spark, languages):
    docs = spark.createDataFrame(languages, SCHEMA).repartition(3)
    net = langid.fit(docs, per_class=150)
    assert net.labels == ["xa", "xb", "xc"]
    found = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert len(found) == len(languages)
    held = [(i, lang) for i, text, lang in languages if i < 900 and fold(i, 4) == 2]
    assert all(found[i].held_out == (fold(i, 4) == 2) for i, _, _ in languages)
    assert np.mean([found[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[1003].lang_pred in SOUNDS
    # other columns, and other ids, change nothing
    renamed = docs.selectExpr("doc_id", "text", "'zz' AS lang", "1 AS known", "2 AS score", "'s' AS source")
    assert {r.doc_id: r.lang_pred for r in langid.identify(renamed, net).collect()} == {i: r.lang_pred for i, r in found.items()}


def test_language_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "xa")], SCHEMA)
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(docs)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 1000):
        text = bytes(np.random.default_rng(n).integers(1, 256, n, np.uint8))
        windows = langid.cut(text)
        assert b"".join(w[: langid.WINDOW].tobytes() for w in windows).rstrip(b"\0") == text.rstrip(b"\0")
        assert windows.shape[1] == langid.WINDOW + 3


def test_network_slopes_are_those_of_its_loss():
    """The forward pass agrees with a convolution written out."""
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 256, (3, langid.WINDOW + 3)).astype(np.uint8)
    net = langid.train(windows, np.array([0, 1, 0]), ["a", "b"], epochs=1)
    pooled = net.pooled(windows)
    for w in range(3):
        for f in (0, langid.FILTERS, 3 * langid.FILTERS - 1):
            kernel = net.filters[:, f].reshape(4, -1)
            best = max(float((net.embed[windows[w, t : t + 4]] * kernel).sum()) for t in range(langid.WINDOW))
            assert abs(best + net.shift[f] - pooled[w, f]) < 1e-4
    assert np.allclose(net.probabilities(windows).sum(axis=1), 1)


def toxic_corpus():
    rng = random.Random(3)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        sentences = [[rng.choice(plain) for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(1, 12))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                rng.choice(sentences).append(rng.choice(["Nasty", "vile", "bastend" + rng.choice("abcdef")]))
        rows.append((i, ". ".join(" ".join(s) for s in sentences) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_texts(spark):
    rows, labels = toxic_corpus()
    rows += [(5000, None), (5001, ""), (5002, "w1 w2"), (5003, "w1 w2. " * 3000 + "you vile w3! w4"), (5003, "w5")]
    labels += [(5000, 1), (5001, None), (None, 1), (7, 1), (7, 0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs.repartition(3), marks, per_class=200)
    scored = toxicity.with_toxicity(docs.selectExpr("doc_id", "1 AS n", "text"), model)
    assert scored.columns == ["doc_id", "n", "text", "score", "sentences"]
    found = {(r.doc_id, r.text): r for r in scored.collect()}
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found.values())
    by_id = {i: r for (i, _), r in found.items() if i < 5000}
    held = [(i, y) for i, y in labels[:1500] if fold(i, 5) == 0]
    assert np.mean([(by_id[i].score >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert all(("asty" in s or "vile" in s or "bastend" in s) for r in found.values() for s in r.sentences)
    assert found[5003, rows[-2][1]].sentences == ["you vile w3"] and found[5000, None].score == found[5001, ""].score == 0
    kept = toxicity.drop_toxic(docs.selectExpr("doc_id", "text", "1 AS score", "2 AS sentences"), marks)
    assert kept.columns == ["doc_id", "text", "score", "sentences"]
    assert 0.7 < kept.count() / len(rows) < 0.8


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b. c"), (2, None)], "doc_id long, text string")
    marks = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score < 0.5 for r in toxicity.with_toxicity(docs, toxicity.fit(docs, marks)).collect()} == {True}
    assert toxicity.with_toxicity(docs.limit(0), toxicity.fit(docs, marks)).count() == 0


def test_toxicity_of_a_long_clean_text(spark):
    rows, labels = toxic_corpus()
    clean = "w1 w2. w3 w4\n" * 100_000
    rows += [(6000, clean), (6001, clean + "you vile w3! w4")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    long = docs.filter("doc_id >= 6000")
    found = {r.doc_id: r.score for r in toxicity.with_toxicity(long, toxicity.fit(docs, marks, per_class=200)).collect()}
    assert found[6000] == 0 and found[6001] >= 0.5
    assert {r.score for r in toxicity.with_toxicity(long, toxicity.NOTHING).collect()} == {0.0}


def test_a_rare_insult_is_learned():
    """Half a per cent of many toxic documents are as good a reason as the whole of few."""
    common = [f"w{i % 97} vile".encode() for i in range(4000)]
    texts = common + [f"w{i % 97} scum".encode() for i in range(30)] + [f"w{i % 97} w{i % 89}".encode() for i in range(4030)]
    labels = np.repeat([1, 0], 4030)
    model = toxicity.train(texts, labels, {0: 1.0, 1: 1.0})
    scores, _ = toxicity.sentences([b"you scum", b"w1 w2", b"vile"]).scored(model, 3)
    assert scores[0] > 0.5 > scores[1] and scores[2] > 0.5


def test_noisy_or_of_sentences():
    model = toxicity.Model(*_sorted([b"vile", b"nasty"], [4.0, 5.0]), -3.0)
    own = toxicity.sentences([b"a VILE b. nasty! c d", b"", b"vile nasty"])
    p = 1 / (1 + np.exp(-own.margins(model)))
    assert np.allclose(p, 1 / (1 + np.exp([-1, -2, 3, -6])))
    assert list(own.text) == [0, 0, 0, 2] and list(own.start) == [0, 10, 17, 0]


def _sorted(names, weights):
    hashes = toxicity.sentences([b" ".join(n for n in names)]).hashes[: len(names)]
    order = np.argsort(hashes)
    return hashes[order], np.array(weights)[order]
