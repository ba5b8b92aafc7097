import hashlib
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions import vectors as V
from vitrine.operators import joins as J
from vitrine.operators.validate import validate, vector_rules
from vitrine.operators.vectors import embed, embed_distinct, fan_out, vec_mean
from vitrine.plans.vector_queries import hashing_model

PAIR = "a array<float>, b array<float>"


def test_hybrid(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], PAIR)
    rows = [r[0] for r in df.select(V.hybrid(F.col("a"), F.col("b"))).collect()]
    assert rows[0] == pytest.approx([1.6, 2.6])
    assert rows[1:] == [None, None]


def test_normalize(values):
    out = values(V.l2_normalize(F.col("v")), [[3.0, 4.0], [0.0, 0.0], None], "v array<float>")
    assert out[0] == pytest.approx([0.6, 0.8])
    assert out[1:] == [None, None]


def test_top_dims_ties_take_the_higher_index(values):
    out = values(V.top_dims(F.col("v"), 2), [[1.0, 3.0, 2.0], [1.0, 1.0, 1.0], [5.0]], "v array<float>")
    assert out == [[1, 2], [2, 1], [0]]


def test_means(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    for dim in (None, 2):
        means = {r["id"]: r["embedding"] for r in vec_mean(df, "id", dim=dim).collect()}
        assert means == {"a": [2.0, 4.0], "b": [0.0, 1.0]}


@pytest.mark.parametrize("dim", [None, 2])
def test_one_rule_for_odd_means(spark, dim):
    rows = [("short", [1.0, 2.0]), ("short", [1.0]), ("hole", [1.0, None]), ("hole", [1.0, 2.0]), ("holes", [None, 1.0]), ("holes", [None, 1.0]),
            ("empty", []), ("empty", [1.0, 2.0]), ("null", None), ("some", None), ("some", [1.0, 2.0]), ("some", [3.0, 2.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    means = {r["id"]: r["embedding"] for r in vec_mean(df, "id", dim=dim).collect()}
    assert means == dict.fromkeys(("short", "hole", "holes", "empty", "null")) | {"some": [2.0, 2.0]}


def test_mean_of_wide_vectors(spark):
    df = spark.range(60).select(
        (F.col("id") % 20).alias("k"), F.transform(F.sequence(F.lit(1), F.lit(768)), lambda n: n * F.col("id")).alias("embedding")
    )
    means = {r["k"]: r["embedding"] for r in vec_mean(df, "k", dim=768).collect()}
    assert all(means[k] == [n * (k + 20.0) for n in range(1, 769)] for k in range(20))
    cut = df.withColumn("embedding", F.slice("embedding", 1, 100))
    assert {r["k"]: r["embedding"] for r in vec_mean(cut, "k", dim=100).collect()} == {k: m[:100] for k, m in means.items()}
    assert {r["embedding"] for r in vec_mean(cut, "k", dim=768).collect()} == {None}


def test_mean_of_variants(values):
    rows = [[[1.0, 2.0], [3.0, 6.0]], [[1.0], [1.0, 2.0]], []]
    out = values(V.mean_of_variants(F.col("v")), rows, "v array<array<float>>")
    assert out == [[2.0, 4.0], None, None]


def test_vector_rules(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    good, rejects = validate(df, vector_rules(F.col("embedding"), 2))
    assert [r["id"] for r in good.collect()] == [1]
    assert {r["id"]: r["reason"] for r in rejects.collect()} == {
        2: "embedding_failed", 3: "bad_dimension", 4: "zero_norm"}


def picky():
    def make_model():
        def run(texts, variants):
            if any(t == "boom" for t in texts):
                raise RuntimeError("bad batch")
            return [None if t == "none" else [float(len(t)), float(v)] for t, v in zip(texts, variants)]

        return run

    return make_model


def test_embed_failures_stay_on_their_row(spark):
    texts = ["abc", "boom", "none", "de", None] * 60
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(2)
    rows = embed(df, "t", picky(), 2, variants=4).collect()
    for r in rows:
        expected = {"abc": [3.0, 1.5], "de": [2.0, 1.5]}.get(r["t"])
        assert r["embedding"] == expected
    assert len(rows) == len(texts)


def counted(folder):
    """``picky``, with a file for each call that holds the number of its values."""
    make_picky = picky()

    def make_model():
        model = make_picky()

        def run(texts, variants):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(str(len(texts)))
            return model(texts, variants)

        return run

    return make_model


def test_one_bad_value_costs_few_calls(spark, tmp_path):
    texts = ["x" * (i % 7) for i in range(128)]
    texts[77] = "boom"
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    rows = embed(df, "t", counted(tmp_path), 2, batch_size=128).collect()
    assert [r["n"] for r in rows if r["embedding"] is None] == [77] and len(rows) == 128
    calls = [int(f.read_text()) for f in tmp_path.iterdir()]
    # small inputs are dealt over the cores, so the batch may have come in parts
    assert len(calls) <= 15 + spark.sparkContext.defaultParallelism and calls.count(1) >= 1


def test_a_filter_on_the_vectors_runs_the_model_once(spark, tmp_path):
    texts = ["x" * (i % 7) for i in range(60)] + ["none"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    embedded = embed(df, "t", counted(tmp_path), 2, variants=4, out="mean")
    unit = embedded.select("n", V.l2_normalize(F.col("mean")).alias("unit"))
    rows = unit.filter("n IS NOT NULL AND unit IS NOT NULL").collect()
    assert sorted(r["n"] for r in rows) == list(range(60))
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) == 4 * 61


def test_hashing_model_splits_at_its_own_white_space():
    model = hashing_model()
    texts = ["a b\u00a0c\x0bd \t\r\f\n a", "", " ", "\u2003x y"]
    tokens = [["a", "b\u00a0c\x0bd", "a"], [], [], ["\u2003x", "y"]]
    for variant in range(3):
        for found, words in zip(model(texts, [variant] * 4), tokens):
            want = [0.0] * 64
            for word in words:
                want[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 64] += 1.0 + variant
            assert list(found) == want
    with pytest.raises(Exception):
        model(["a", None], [0, 0])


@pytest.mark.parametrize("hot_floor", [J.HOT_FLOOR, 50])
def test_distinct_values_are_embedded_once(spark, tmp_path, monkeypatch, hot_floor):
    monkeypatch.setattr(J, "HOT_FLOOR", hot_floor)
    texts = ["hot"] * 300 + [f"text {i}" for i in range(150)] * 2 + [None, None, "", "boom", "none", "boom"]
    rows = [(i, t, "found", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "n int, t string, found string, embedding int")
    found = embed_distinct(df, "t", counted(tmp_path), 2, variants=2).collect()
    want = {r["n"]: r["embedding"] for r in embed(df.drop("embedding"), "t", picky(), 2, variants=2).collect()}
    assert {r["n"]: r["embedding"] for r in found} == want and len(found) == len(texts)
    assert all((r["t"], r["found"]) == (texts[r["n"]], "found") for r in found) and found[0].__fields__ == ["n", "t", "found", "embedding"]
    # 155 distinct values in two variants, and the halves of batches with one of the two that fail
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) < 2 * 2 * 155 * 3


def test_distinct_of_no_rows(spark):
    assert embed_distinct(spark.createDataFrame([], "t string"), "t", picky(), 2).collect() == []


def test_embed_wrong_dimension_is_null(spark):
    df = spark.createDataFrame([("abc",)], "t string")
    assert embed(df, "t", picky(), 3).first()["embedding"] is None


def test_fan_out(spark):
    assert [r["variant_no"] for r in fan_out(spark.range(1), 4).collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_kernels_agree(spark, metric):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(50)]
    rows += [(50, [0.0] * 6), (51, [1.0]), (52, None)]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    q = rng.normal(size=6).tolist()
    found = df.select(
        V.score(F.col("v"), q, metric).alias("a"), V.score(F.col("v"), q, metric, "arrow").alias("b")
    ).collect()
    for r in found:
        assert (r["a"] is None) == (r["b"] is None)
        if r["a"] is not None:
            assert r["a"] == pytest.approx(r["b"], abs=1e-9)
    with pytest.raises(ValueError):
        V.score(F.col("v"), q, "other")
