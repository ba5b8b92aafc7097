import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.functions.minhash import BANDS, ROWS, band_keys, band_layout, vector_band_keys
from vitrine.functions.vectors import top_dims
from vitrine.operators import neardup as N

SCHEMA = "order_no long, buckets array<long>"


def greedy(rows):
    taken, kept = set(), set()
    for order, buckets in sorted(rows):
        if not taken & set(buckets or []):
            taken |= set(buckets or [])
            kept.add(order)
    return kept


def run(spark, rows, tail_rows):
    df = spark.createDataFrame(rows, SCHEMA)
    kept, dropped = N.drop_near_dups(df, "order_no", F.col("buckets"), tail_rows)
    k, d = ({r["order_no"] for r in part.collect()} for part in (kept, dropped))
    assert not k & d and k | d == {order for order, _ in rows}
    return k


def instances(seed, n_instances, n_rows, n_buckets, width):
    """Many independent random inputs side by side, order numbers shuffled across them."""
    rng = random.Random(seed)
    numbers = rng.sample(range(10 * n_instances * n_rows), n_instances * n_rows)
    rows = []
    for i in range(n_instances):
        for _ in range(rng.randint(1, n_rows)):
            size = rng.randint(0, width)
            rows.append((numbers.pop(), [i * 10_000 + rng.randrange(n_buckets) for _ in range(size)]))
    return rows


@pytest.mark.parametrize("tail_rows", [0, 40, N.TAIL_ROWS])
@pytest.mark.parametrize("hot_floor", [N.HOT_FLOOR, 1])
def test_equals_the_sequential_walk(spark, monkeypatch, tail_rows, hot_floor):
    monkeypatch.setattr(N, "HOT_FLOOR", hot_floor)
    rows = instances(tail_rows + hot_floor, 60, 25, 14, 5)
    assert run(spark, rows, tail_rows) == greedy(rows)


def test_dropped_rows_suppress_nothing(spark):
    rows = [(1, [10]), (2, [10, 20]), (3, [20])]
    assert run(spark, rows, 0) == {1, 3}


def test_chain(spark):
    rows = [(i, [i, i + 1]) for i in range(9)]
    assert run(spark, rows, 0) == {0, 2, 4, 6, 8}


def test_hot_group_of_copies(spark):
    rows = [(i, [1, 2, 3]) for i in range(5000)] + [(9000 + i, [100 + i]) for i in range(50)]
    assert run(spark, rows, 0) == {0} | {9000 + i for i in range(50)}


def test_rows_without_buckets_are_kept(spark):
    rows = [(1, []), (2, None), (3, []), (4, [5]), (5, [5])]
    assert run(spark, rows, 0) == {1, 2, 3, 4}


def test_vectors_and_their_scaled_copies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(80)]
    rows += [(1000 + i, [x * 1.01 for x in v]) for i, v in rows]
    df = spark.createDataFrame(rows, "n long, v array<double>")
    kept, _ = N.drop_near_dups(df, "n", N.signature_buckets(F.col("v"), 8))
    assert sorted(r["n"] for r in kept.collect()) == list(range(80))


def test_band_keys_estimate_similarity(spark):
    """Rows share a band key far more often when their token sets overlap more."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        base = rng.sample(range(10_000), 100)
        near, far = base[:99] + [20_000], base[:50] + rng.sample(range(20_000, 30_000), 50)
        rows.append((i, base, near, far))
    df = spark.createDataFrame(rows, "i int, a array<int>, b array<int>, c array<int>")
    keys = df.select(*[band_keys(F.col(c)).alias(c) for c in "abc"], band_keys(F.reverse("a")).alias("r"))
    found = keys.collect()
    near = sum(bool(set(r["a"]) & set(r["b"])) for r in found)
    far = sum(bool(set(r["a"]) & set(r["c"])) for r in found)
    assert near > 280 and far == 0
    assert all(r["a"] == r["r"] and len(set(r["a"])) == 5 for r in found)


def test_band_keys_of_no_tokens(spark):
    df = spark.createDataFrame([([1],), ([],), (None,), ([1],)], "t array<int>").coalesce(1)
    a, b, c, d = (r[0] for r in df.select(band_keys(F.col("t"))).collect())
    assert b is None and c is None and a == d and len(a) == 5
    with pytest.raises(ValueError):
        band_keys(F.col("t"), 10, 5, 3)


def test_vector_keys_equal_token_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.normal(size=30).round(1).tolist(),) for _ in range(200)] + [(None,), ([],)]
    df = spark.createDataFrame(rows, "v array<float>").coalesce(1)
    found = df.select(
        vector_band_keys(F.col("v"), 9).alias("a"), band_keys(top_dims(F.col("v"), 9)).alias("b")
    ).collect()
    assert all(r["a"] == r["b"] for r in found)
    assert sum(r["a"] is None for r in found) == 2


def test_band_layout():
    assert band_layout(0.9, 128) == (BANDS, ROWS)
    bands, rows = band_layout(0.5, 128)
    assert bands * rows <= 128 and (1 / bands) ** (1 / rows) == pytest.approx(0.5, abs=0.1)


def test_whole_texts_against_a_walk(spark):
    """Every bucket computed by hand from all words, then the walk in order of the ids."""
    import re

    import xxhash

    from vitrine.functions.minhash import PERMUTATIONS, BandHasher, band_layout
    from vitrine.plans.vector_queries import near_dup_texts

    folder = "/root/testdata/sf0.001"
    hasher = BandHasher(PERMUTATIONS, *band_layout(0.8), seed=1)
    taken, want = set(), {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect():
        words = re.findall(r"[^ \t\n\x0b\f\r]+", (r["text"] or "").lower())
        runs = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        tokens = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in runs], np.uint64).view(np.int64)
        own = set(hasher.combine(lambda p: hasher.permuted(tokens, p).min(), 1)[0].tolist()) if len(tokens) else set()
        want[r["doc_id"]] = taken.isdisjoint(own)
        taken |= own if want[r["doc_id"]] else set()
    found = {r["doc_id"]: r["kept"] for r in near_dup_texts(spark, folder).collect()}
    assert found == want and 0 < sum(not k for k in want.values()) < len(want) / 2
