"""Token counts and byte-pair codes against the libraries that define them."""

import base64
import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitrine.llm.bpe import codec, decoded, encode_documents, encoded
from vitrine.llm.tokencount import _WORDS, counter, prefix_counts, token_counts, truncated

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
library = Tokenizer.from_file(WORDS)
with open(RANKS, "rb") as source:
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
tik = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

alphabet = st.one_of(
    st.characters(exclude_categories=["Cs"]), st.sampled_from("aeiourstnlé 'ßΣσİ\n\t12"),
    st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'ll", "  ", "\x1c", "\x85", " ", "é"]),
)
texts = st.lists(alphabet, max_size=40).map("".join)
ODD = ["", None, " ", "a" * 5000, "é" * 333, "ab" * 700 + " " * 90 + "x", "<|endoftext|> a<|startoftext|>b", "ΑΣ ΣΑΣ", "日本語 text",
       "supercalifragilistic" * 30, "\n\n  \t x", "1234567890" * 9, "don't we'll I'D", "!?!?!?" * 100, "antidisestablishmentarianism"]


def count(text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_total_is_the_librarys(text):
    assert counter(WORDS).total(text) == count(text)


def test_every_character_counts_as_in_the_library():
    """Alone and behind a letter; among them are letters newer than Python's tables."""
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    own = counter(WORDS)
    for start in range(0, len(chars), 100_000):
        part = [form for c in chars[start : start + 100_000] for form in (c, f"a{c}")]
        found = library.encode_batch_fast(part, add_special_tokens=False)
        assert [own.total(t) for t in part] == [len(e.ids) for e in found]


def test_a_very_long_text():
    text = "Ωmega wörd 12 " * 40_000 + "x" * 100_000
    assert counter(WORDS).total(text) == count(text)
    assert codec(RANKS, PATTERN).encode(text) == tik.encode_ordinary(text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdefghinorstu é'1!ßΩ", max_size=30))
def test_every_prefix_has_its_own_count(text):
    counts = counter(WORDS)
    whole, ends, totals = counts.prefixes(text)
    assert [count(whole[:e]) for e in ends] == totals
    for m in _WORDS.finditer(whole):
        if not regex.fullmatch(r"\p{L}+", m.group()):
            continue
        before = count(whole[: m.start()])
        for n in range(1, len(m.group()) + 1):
            assert before + counts.inside(m.group(), n) == count(whole[: m.start() + n])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdehinorstu é'1!", max_size=40), st.integers(0, 12))
def test_cut_keeps_the_budget(text, budget):
    kept, n = counter(WORDS).cut(text, budget)
    assert n == count(kept) <= budget
    whole, ends, totals = counter(WORDS).prefixes(text)
    assert whole.startswith(kept)
    assert len(kept) >= max([e for e, t in zip(ends, totals) if t <= budget], default=0)


def test_counts_of_odd_rows(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens", "2 AS n_bytes")
    found = sorted(tuple(r) for r in token_counts(docs, WORDS).collect())
    assert found == [(i, len((t or "").encode()), count(t)) for i, t in enumerate(ODD)]
    assert token_counts(docs.limit(0), WORDS).count() == 0
    first = {r.doc_id: r for r in prefix_counts(docs, WORDS).collect()}
    assert all((first[i].totals or [0])[-1] == count(t) for i, t in enumerate(ODD))
    cut = {r.doc_id: r for r in truncated(docs, WORDS, 7).collect()}
    assert all(r.n_tokens == count(r.text) <= 7 for r in cut.values())


@settings(max_examples=300, deadline=None)
@given(texts)
def test_codes_are_the_librarys(text):
    own = codec(RANKS, PATTERN)
    ids = own.encode(text)
    assert ids == tik.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinorst", min_size=33, max_size=400))
def test_tree_reduction_is_the_merge_of_the_whole(word):
    own = codec(RANKS, PATTERN)
    raw = word.encode()
    assert own.reduce(raw) == own.leaf(raw) == own._long(raw) == tik._encode_single_piece(raw)


@pytest.mark.parametrize("unit", ["a", "ab", "the", "aab", "é", "=", "xyzzy", "0"])
def test_tree_reduction_of_repetitive_runs(unit):
    own = codec(RANKS, PATTERN)
    for n in (40, 63, 64, 65, 1000, 4097):
        raw = (unit * n).encode()
        assert own.reduce(raw) == tik._encode_single_piece(raw)


def test_tree_reduction_of_vocabulary_mixtures():
    rng, own = random.Random(5), codec(RANKS, PATTERN)
    tokens = [t for t in table if t.isalpha()]
    for _ in range(300):
        raw = b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 30)))
        assert own.reduce(raw) == tik._encode_single_piece(raw)


def test_round_trip_of_odd_rows(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS part")
    found = {r.doc_id: r for r in decoded(encoded(docs, RANKS, PATTERN), RANKS, PATTERN).collect()}
    for i, text in enumerate(ODD):
        assert found[i].ids == tik.encode_ordinary(text or "")
        assert bytes(found[i].decoded) == (text or "").encode() and found[i].text == text
    assert encoded(docs.limit(0), RANKS, PATTERN).count() == 0
    clash = encode_documents(docs.withColumn("ids", docs.doc_id), RANKS, PATTERN)
    assert clash.columns[:4] == ["doc_id", "text", "part", "ids"] and len(clash.columns) == 5
