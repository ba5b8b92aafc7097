"""Token alignment against a plain walk over every text's bytes."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitrine.llm import alignment
from vitrine.llm.alignment import align, group_texts, merged, packed, unpacked

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
first = Tokenizer.from_file(PATHS[0])
first.encode_special_tokens = True
second = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
ODD = ["", None, " ", "a", "  two  spaces ", "▁ is a space there", "<|endoftext|> and <s> </s> <0x41>", "日本語のテキスト 🙂🙃",
       "don't we'll", "x" * 3000, "a\u0000b", "line\nline\r\n\ttab", "é" * 50, "   wide", "ab" * 1_500]


def byte_table():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {}, 0
    for b in range(256):
        if b in plain:
            chars[chr(b)] = b
        else:
            chars[chr(256 + extra)] = b
            extra += 1
    return chars


BYTES = byte_table()


def spans(text):
    """``(id, start, end)`` of the tokens of both, or None where they do not spell the text."""
    want, out = (" " + text).encode(), []
    ids = first.encode(" " + text, add_special_tokens=False).ids
    sides = [[(i, bytes(BYTES[c] for c in first.id_to_token(i))) for i in ids]]
    sides.append([(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i)
                   else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)])
    for side in sides:
        if b"".join(b for _, b in side) != want:
            return None
        at, found = 0, []
        for i, b in side:
            found.append((i, at, at + len(b)))
            at += len(b)
        out.append(found)
    return out


def by_hand(rows):
    told, links = [], []
    for doc_id, text in rows:
        both = spans(text) if text else None
        if both is None:
            told.append((doc_id, 0, 0, 0, ""))
            links.append([])
            continue
        a, b = both
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        start, parts = 0, []
        for cut in cuts:
            parts.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= cut) for side in both))
            start = cut
        digest = hashlib.sha256(";".join(parts).encode()).hexdigest()
        told.append((doc_id, len(a), len(b), len(cuts), digest))
        own, j = [], 0
        for i, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                own.append((i, b[k][0]))
                k += 1
        links.append(own)
    counts = Counter(p for own in links for p in own)
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = [(d, a, b, g, len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), digest)
            for (d, a, b, g, digest), own in zip(told, links)]
    return rows, {(a, b, n, n == best[b]) for (a, b), n in counts.items()}


def key(row):
    return [(v is not None, str(v)) for v in row]


def sample(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    return [(i, t) for i, t in enumerate([*ODD, *texts[:30], texts[3], texts[3]])] + [(None, "a null id"), (4, "a"), (4, "a")]


@pytest.mark.parametrize(("links", "group"), [(1_500_000, 32 << 20), (4000, 2000)])
def test_documents_and_pairs(spark, monkeypatch, links, group):
    monkeypatch.setattr(alignment, "RUN_LINKS", links)
    monkeypatch.setattr(alignment, "GROUP_BYTES", group)
    monkeypatch.setattr(alignment, "FRAME", 500)
    rows = sample(spark)
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, n_a int").repartition(3)
    found = align(docs, *PATHS)
    documents, pairs = by_hand(rows)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in found.documents.select(columns).collect()), key=key) == sorted(documents, key=key)
    assert {tuple(r) for r in found.pairs.select("a_id", "b_id", "links", "best").collect()} == pairs


def test_group_texts(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    found = dict(map(tuple, group_texts(docs, *PATHS).collect()))
    assert found[2] == ""
    a, b = spans("Hello there")
    assert sorted(i for g in found[1].split(";") for i in map(int, g.split("|")[0].split(","))) == sorted(i for i, _, _ in a)
    assert sorted(i for g in found[1].split(";") for i in map(int, g.split("|")[1].split(","))) == sorted(i for i, _, _ in b)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = align(docs, *PATHS)
    assert found.documents.collect() == [] and found.pairs.collect() == []


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), min_size=1, max_size=60), max_size=6), st.integers(1, 9))
def test_heap_merge_counts(runs, frame):
    stored, total = [], Counter()
    for run in runs:
        values, counts = np.unique(np.array(run, np.uint64), return_counts=True)
        frames = [packed(values[i : i + frame], counts[i : i + frame]) for i in range(0, len(values), frame)]
        stored.append((10, frames))
        total.update(v // 10 for v in run)
    found, before = Counter(), -1
    for pairs, counts in merged(stored):
        assert (np.diff(pairs.astype(np.int64)) > 0).all() and pairs[0] >= before
        before = pairs[-1]
        found.update(dict(zip(pairs.tolist(), counts.tolist())))
    assert found == total


def test_frames_round_trip():
    values = np.array([0, 5, 2**40, 2**62], np.uint64)
    back = unpacked(packed(values, np.array([1, 2, 3, 4])))
    assert back[0].tolist() == values.tolist() and back[1].tolist() == [1, 2, 3, 4]
