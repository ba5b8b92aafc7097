"""Exact search by approximation, and the stages one after the other."""

import math
import random

import numpy as np
import pytest

from vitrine.llm.components import components
from vitrine.llm.topk_va import top_products, whole_vectors


def best_by_hand(rows, queries, k):
    out = []
    for q, v in queries:
        scores = sorted((-int(sum(a * b for a, b in zip(v, w))), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("scale", "cells", "copies"), [(300, 64, 0), (300, 4, 200), (3, 64, 50), (2**28, 16, 0)])
def test_top_products(spark, monkeypatch, scale, cells, copies):
    import vitrine.llm.topk_va as module

    monkeypatch.setattr(module, "BLOCK_VECTORS", 70)
    monkeypatch.setattr(module, "BLOCK_QUERIES", 11)
    monkeypatch.setattr(module, "LEAST_BLOCKS", 3)
    rng = np.random.default_rng(int(scale % 97) + cells)
    rows = [(i, [int(x) for x in rng.integers(-scale, scale, 8)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(copies)] + [(2000 + i, [1, 2, 3]) for i in range(4)]
    random.Random(1).shuffle(rows)
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    asked = [(i, v) for i, v in rows if i % 10 == 0]
    found = top_products(vectors, vectors.filter("vec_id % 10 = 0"), 5, cells)
    assert sorted(tuple(r) for r in found.collect()) == best_by_hand(rows, asked, 5)


def test_products_beyond_64_bits_raise(spark):
    far = spark.createDataFrame([(1, [2.0e8] * 4), (2, [1.0] * 4), (3, [2.0e8, 0.0, 0.0, 1.0])], "vec_id long, embedding array<double>")
    whole = whole_vectors(far)
    with pytest.raises(ValueError, match=r"\[1, 3, 2\]"):
        top_products(whole, whole, 2)
    near = whole_vectors(far.filter("vec_id > 1"))
    found = top_products(near, near.filter("vec_id = 2"), 2)  # the wide vector's product fits
    assert [tuple(r) for r in found.collect()] == [(2, 1, 3, 256 * (256 * 200_000_000 + 256))]
    with pytest.raises(Exception, match="leaves 64 bits in vector 9"):
        whole_vectors(spark.createDataFrame([(9, [1.0e30])], "vec_id long, embedding array<double>")).collect()


def test_top_products_of_odd_rows(spark):
    nan, inf = math.nan, math.inf
    rows = [(0, [0.5, -0.25]), (1, [0.5, 0.001]), (2, [nan, 1.0]), (3, [inf, 0.0]), (4, None), (5, [None, 1.0]), (None, [1.0, 1.0]),
            (6, []), (7, [0.5, 0.001]), (7, [0.5, 0.001]), (8, [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("vec_id", "embedding", "1 AS v", "2 AS block")
    whole = whole_vectors(vectors)
    assert {r.vec_id: r.v for r in whole.collect()} == {0: [128, -64], 1: [128, 0], 6: [], 7: [128, 0], 8: [0, 0]}
    found = top_products(whole, whole.filter("vec_id in (0, 6)"), 2)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 1, 1, 16384), (0, 2, 7, 16384)]
    assert top_products(whole.limit(0), whole.limit(0), 2).count() == 0
    assert top_products(whole, whole.limit(0), 2).count() == 0


@pytest.mark.parametrize("cells", [4, 256])
def test_ties_do_not_pile_up(spark, monkeypatch, cells):
    import vitrine.llm.topk_va as module

    counts = {}

    def counted(possible, k, run=module._still_possible):
        left = run(possible, k)
        for name, rows in (("blocks", possible), ("all", left)):
            counts[name] = {r.query_id: r["count"] for r in rows.groupBy("query_id").count().collect()}
        return left

    monkeypatch.setattr(module, "LEAST_BLOCKS", 3)
    monkeypatch.setattr(module, "_still_possible", counted)
    rng = np.random.default_rng(5)
    rows = [(i, [0] * 6 if i % 3 == 0 else [int(x) for x in rng.integers(-90, 90, 6)]) for i in range(900)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    found = top_products(vectors, vectors.filter("vec_id % 50 = 0"), 5, cells)
    asked = [(i, v) for i, v in rows if i % 50 == 0]
    assert sorted(tuple(r) for r in found.collect()) == best_by_hand(rows, asked, 5)
    for i, v in asked:
        if not any(v):
            assert counts["blocks"][i] <= 5 * 3 and counts["all"][i] == 5


def test_a_zero_query_keeps_k_of_a_block():
    import pyarrow as pa

    from vitrine.llm.topk_va import _scan

    rows = [[i % 11, i % 7] for i in range(200)]
    queries = pa.table({"query_id": pa.array([3]), "v": pa.array([[0, 0]])})
    cells = pa.array([bytes(r) for r in rows])
    fixed = {c: pa.array([v] * 200) for c, v in (("low", [0, 0]), ("width", [1, 1]))}
    found = _scan(5)(queries, pa.table({"vec_id": pa.array(range(200))[::-1], "cells": cells, **fixed}))
    assert sorted(found["vec_id"].to_pylist()) == [0, 1, 2, 4, 5]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 90)] + [(500, x) for x in range(400, 480)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls, repeated ids and rows, empty tables and columns with clashing names."""
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    text = " ".join(f"word{i}" for i in range(30))
    rows = [(3, text), (3, text), (5, "only here " * 8), (5, text), (None, None), (None, text), (6, ""), (6, ""), (7, None)]
    docs = spark.createDataFrame([(d, t, None, "s", None, 1, 2) for d, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, row int, kept int")
    want = sorted([(3, text), (5, "only here " * 8), (None, None), (None, text), (6, ""), (6, ""), (7, None)], key=str)
    for given in (docs, docs.limit(0)):
        seen = given
        for name, apply in corpus_pipeline.STAGES:
            seen = apply(spark, seen, folder)
            assert set(docs.columns) <= set(seen.columns)
            if name == "near_dedup" and given is docs:
                assert sorted(((r.doc_id, r.text) for r in seen.collect()), key=str) == want
        assert seen.count() == (len(want) if given is docs else 0)


def test_pipeline(spark):
    import corpus_pipeline
    from vitrine.llm.queries import QUERIES
    from vitrine.llm.tables import table

    folder = "/root/testdata/sf0.001"
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"] and corpus_pipeline.ORACLE_SQL is None
    docs = table(spark, folder, "documents")
    toxic = {r.doc_id for r in QUERIES["op7_toxicity"](spark, folder).filter("predicted = 1").collect()}
    seen = docs
    for name, apply in corpus_pipeline.STAGES[:-1]:
        after = apply(spark, seen, folder)
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        kept = {r.doc_id: r for r in after.collect()}
        before = {r.doc_id: r for r in seen.collect()}
        assert set(kept) <= set(before)
        if name == "toxicity":
            assert set(before) - set(kept) == toxic
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert all(kept[i] == before[i] for i in kept)
        if name == "pii":
            assert set(kept) == set(before) and all(r.n_chars == len(r.text) for r in kept.values())
        seen = spark.createDataFrame(list(kept.values()), docs.schema)
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(result) == {r.doc_id for r in seen.collect()}
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as source:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, source)}
    tik = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(r.ids == tik.encode_ordinary(r.text) for r in result.values())
