"""Collocations against plain counting, and the trie against a dictionary."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import collocations as module
from vitrine.llm.collocations import best_of_each, build_trie, collocations, frequent_phrases
from vitrine.session import stage

SCHEMA = "doc_id long, text string, lang string"
TEXTS = ["the New York times.the new\tyork post", "a b c a b c a b c", "of the of the of the", "", None, "x;y:z!w?v", "é è é è", "tick\rtock tick tock",
         "no no no no no no", "one  two \t three", "\x0bone two three", "İ ß İ ß"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def by_hand(rows, least, longest=3, contained=50):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                counts.update((lang or "und", tuple(words[i : i + size])) for i in range(len(words) - size + 1))
    frequent = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = []
    for (lang, words), a in frequent.items():
        if any(other == lang and len(w) > len(words) and 100 * f >= contained * a and any(w[i : i + len(words)] == words for i in range(len(w)))
               for (other, w), f in frequent.items()):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1_000_000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((lang, " ".join(words), len(words), a, left, right, totals[lang], score))
    return out


def sample(seed=5):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "new", "York", "die", "é", "of", "the", "x1", "Ω"]
    rows = []
    for i in range(150):
        picked = rng.zipf(1.4, rng.integers(0, 60)) % len(words)
        text = "".join(words[k] + str(rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"])) for k in picked)
        rows.append((i, text, ["en", "de", None][i % 3]))
    rows += [(200 + i, t, "en") for i, t in enumerate(TEXTS * 4)] + [(7, "the same row", "und")] * 12
    return rows + [(None, "the same row", None), (900, "long " * 60_000, "de")]


@pytest.mark.parametrize(("least", "longest", "contained", "trie"), [(10, 3, 50, 1_000_000), (3, 3, 50, 40), (2, 4, 80, 300)])
def test_phrases(spark, monkeypatch, least, longest, contained, trie):
    monkeypatch.setattr(module, "TRIE_PHRASES", trie)
    rows = sample()
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", word string, n int").repartition(4)
    found = collocations(table, least, longest, contained)
    assert sorted(map(tuple, found.collect())) == sorted(by_hand(rows, least, longest, contained))


def test_small_batches_and_bitmaps(spark, monkeypatch):
    """Few buckets and early flushes change no result."""
    for name, value in (("BATCH_WORDS", 500),):
        monkeypatch.setattr(module, name, value)
    rows = sample(9)
    assert sorted(map(tuple, collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), 4).collect())) == sorted(by_hand(rows, 4))


def test_ranks(spark):
    rows = sample()
    found = best_of_each(collocations(spark.createDataFrame(rows, SCHEMA), 2), 15).collect()
    for lang in {r["lang"] for r in found}:
        own = sorted((r for r in by_hand(rows, 2) if r[0] == lang), key=lambda r: (-r[7], -r[3], r[1].encode()))[:15]
        assert [(r["rank"], r["phrase"]) for r in sorted(found, key=lambda r: r["rank"]) if r["lang"] == lang] == [(i, r[1]) for i, r in enumerate(own, 1)]


def test_products_beyond_64_bits(spark, monkeypatch):
    """Counts of a corpus of 10 ** 13 words."""
    a, most = 7_000_000_000_001, 9_999_999_999_999
    words = spark.createDataFrame([("en", 1, "x", most), ("en", 2, "y", most - 5)], "lang string, hash long, word string, n long")
    found = [spark.createDataFrame([("en", 1, most), ("en", 2, most - 5)], "lang string, w0 long, f long"),
             spark.createDataFrame([("en", 1, 2, a)], "lang string, w0 long, w1 long, f long")]
    monkeypatch.setattr(module, "frequent_phrases", lambda *_: (words, found))
    row = collocations(words.selectExpr("lang", "word AS text"), 10, 2).first()
    assert row["score"] == 1_000_000 * a * a // (most * (most - 5))


def test_empty_table(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [f.count() for f in frequent_phrases(spark.createDataFrame([(1, None, None)], SCHEMA))[1]] == [0, 0, 0]


@settings(max_examples=40, deadline=None)
@given(st.sets(st.tuples(st.sampled_from(["en", "de"]), st.integers(1, 9), st.integers(1, 9)), min_size=1), st.lists(st.integers(0, 10), max_size=80))
def test_trie_counts(phrases, text):
    phrases = sorted(phrases)
    trie = build_trie([p[0] for p in phrases], np.array([p[1:] for p in phrases], np.uint64))
    words = np.array(text, np.uint64)
    for lang in ("en", "de", "fr"):
        states = trie.accepted(lang, words)
        want = Counter(p for p in phrases for i in range(len(text) - 1) if p[0] == lang and p[1:] == tuple(text[i : i + 2]))
        assert Counter(phrases[i] for i in trie.accepts[states].tolist()) == want


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 65_535), st.integers(1, 2**62), min_size=1))
def test_counts_travel_unchanged(counts):
    places = np.array(sorted(counts), np.int64)
    found = module.unpack_counts(module.pack_counts(places, np.array([counts[p] for p in places.tolist()], np.int64)))
    assert dict(zip(*map(np.ndarray.tolist, found))) == counts


def test_sums_of_blocks():
    """Blocks add up over rows and tasks; with a bound no sum goes beyond it."""
    rows = [(np.array([3, 70_000]), np.array([4, 9])), (np.array([3, 5]), np.array([8, 1]))]
    batches = [b for numbers, counts in rows for b in module._block_rows(numbers, counts, 16)]
    for most, want in ((None, 12), (10, 10)):
        sums = dict(module._block_sums(iter(batches), 16, most))
        assert (sorted(sums), sums[0][3], sums[0][5], sums[1][70_000 - 65_536], sums[0].sum()) == ([0, 1], want, 1, 9, want + 1)


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3)), min_size=1, max_size=40), st.integers(1, 3))
def test_distinct_rows(rows, cuts):
    parts = [p for p in np.array_split(np.array(rows, np.uint64), cuts)]
    assert list(map(tuple, module.distinct_rows(parts).tolist())) == sorted(set(rows))


def test_sequences_of_any_texts():
    texts = [b"", b"A b\tc.d", b"!!", b" lone ", b"", "é\x0bÉ".encode(), b"x" * 3000 + b" a", b"b"]
    words, sequences = module.word_sequences(texts)
    spelled = {h: words.data[s:e] for h, s, e in zip(words.hashes.tolist(), words.starts.tolist(), words.ends.tolist())}
    assert len(spelled) == len(set(spelled.values())) == 8
    shown = [[spelled.get(h, b".") for h in sequence.tolist()] for sequence in sequences]
    assert shown == [[b"."], [b"a", b"b", b"c", b".", b"d", b"."], [b".", b".", b"."], [b"lone", b"."], [b"."],
                     ["é".encode(), b".", "É".encode(), b"."], [b"x" * 3000, b"a", b"."], [b"b", b"."]]


def test_passes_do_not_grow_with_the_candidates(spark, monkeypatch):
    """However many tries the candidates of a level need, a level reads the texts twice and is written once."""
    rows, found = sample(3), {}
    for trie in (1_000_000, 30):
        monkeypatch.setattr(module, "TRIE_PHRASES", trie)
        labels = []
        monkeypatch.setattr(module, "stage", lambda df, label, labels=labels: labels.append(label) or stage(df, label))
        phrases = frequent_phrases(spark.createDataFrame(rows, SCHEMA).repartition(2), 2)[1]
        found[trie] = labels, [sorted(map(tuple, f.collect())) for f in phrases[1:]]
    assert found[30] == found[1_000_000]
    assert found[30][0].count("phrases") == 2 and all(len(f) > 60 for f in found[30][1])


def test_bits_are_of_whole_hashes():
    """Hashes that share a place of the bitmap are counted apart, over rows and tasks."""
    bits, power, least = 16, 3, 3
    rng = np.random.default_rng(1)
    hashes = rng.integers(2**63, size=500).astype(np.uint64)
    alike = (hashes[:1] & np.uint64(0xFFFF)) | (np.arange(1, 9, dtype=np.uint64) << np.uint64(20))
    batches = [np.r_[hashes, alike, hashes[:20]], hashes[:30]]
    rows = []
    for batch in batches:
        monkey = pytest.MonkeyPatch()
        monkey.setattr(module, "_texts", lambda _, batch=batch: [("en", batch)])
        monkey.setattr(module, "_open", lambda lang, words, size, below: (None, words))
        below = type("Held", (), {"value": None})
        for sent in module._phrase_counts(2, below, bits, power, least)(iter([])):
            rows += zip(sent.column(0).to_pylist(), sent.column(1).to_pylist())
        monkey.undo()
    rows.sort(key=lambda row: row[0])
    sent = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "counts"])
    out = np.zeros(1 << 13, np.uint8)
    for block in module._crowded_hashes(bits, power, least)(iter([sent])):
        out[block.column(0)[0].as_py() << 10 :][: 1 << 10] = np.frombuffer(block.column(1)[0].as_py(), np.uint8)
    assert module._set(out, hashes[:20]).all() and not module._set(out, np.r_[hashes[20:], alike]).any()


@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(1, 2**32 - 1)), min_size=1, max_size=40))
def test_phrases_travel_unchanged(rows):
    words, counts = np.array([r[:2] for r in rows], np.uint64).reshape(-1, 2), np.array([r[2] for r in rows], np.int64)
    found = module.unpack_phrases(module.pack_phrases(words, counts), 2)
    assert (found[0] == words).all() and found[1].tolist() == counts.tolist()


DEALT = st.tuples(st.sampled_from(["de", "en"]), st.integers(1, 5), st.integers(1, 5), st.integers(1, 99))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(DEALT, min_size=1), min_size=1, max_size=5), st.integers(1, 12))
def test_counts_of_dealt_phrases(batches, trie):
    """Rows of candidates add up, in one trie or in several."""
    rows, want = [], Counter()
    for batch in batches:
        batch = sorted(batch)
        langs = sorted({r[0] for r in batch})
        packed = module.pack_phrases(np.array([r[1:3] for r in batch], np.uint64), np.array([r[3] for r in batch]))
        rows.append((0, langs, [sum(r[0] == lang for r in batch) for lang in langs], packed))
        for lang, one, two, n in batch:
            want[lang, one, two] += n
    found = [((t.langs[i], *t.words[i].tolist()), n) for t, total in module.count_phrases(rows, 2, trie) for i, n in enumerate(total.tolist())]
    assert len(found) == len(want) and dict(found) == want


def test_languages_are_ranked_in_parts(spark):
    """What arrives by language is dealt anew before it is ranked."""
    rows = spark.createDataFrame([("en", "a", 5, 1)], "lang string, phrase string, score long, a long").repartition(3, "lang")
    plan = best_of_each(rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(lang" in plan and "part#" in [line for line in plan.splitlines() if "hashpartitioning(lang" in line][1]
