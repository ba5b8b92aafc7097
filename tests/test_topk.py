import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import ivf
from vitrine.operators import topk as K
from vitrine.operators.validate import compile_filter


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 16)).astype(np.float32).astype(float)
    vectors[300:] = vectors[:100]  # exact copies force ties
    rows = [(i, f"id{i:04d}", v.tolist(), i % 5, float(i)) for i, v in enumerate(vectors)]
    rows += [(400, "id0400", [0.0] * 16, 0, 0.0), (401, "id0401", None, 0, 0.0), (402, "id0402", [1.0], 0, 0.0)]
    schema = "id long, name string, embedding array<float>, grp int, price double"
    return spark.createDataFrame(rows, schema).repartition(5).cache(), vectors


def brute(vectors, q, k, metric, allowed=None):
    if metric == "cosine":
        s = -np.round(vectors @ q / np.linalg.norm(vectors, axis=1) / np.linalg.norm(q), 12)
    else:
        s = np.round(np.linalg.norm(vectors - q, axis=1), 12)
    ids = [i for i in np.lexsort((np.arange(len(vectors)), s)) if allowed is None or allowed(i)]
    return ids[:k]


def with_origin(vectors):
    """The zero vector has no cosine but does have a distance."""
    return np.vstack([vectors, np.zeros((1, vectors.shape[1]))])


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("kernel", ["jvm", "arrow"])
def test_single(corpus, metric, kernel):
    index, vectors = corpus
    all_vectors = vectors if metric == "cosine" else with_origin(vectors)
    for seed in range(3):
        q = np.random.default_rng(seed).normal(size=16)
        found = [r["id"] for r in K.topk(index, q.tolist(), 7, metric, kernel=kernel).collect()]
        assert found == brute(all_vectors, q, 7, metric)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("block_bytes", [K.BLOCK_BYTES, 1000])
@pytest.mark.parametrize("cells", [K._CELLS, 200])
def test_batch_equals_brute_force(spark, corpus, monkeypatch, metric, block_bytes, cells):
    monkeypatch.setattr(K, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(K, "_CELLS", cells)
    index, vectors = corpus
    queries = np.random.default_rng(9).normal(size=(12, 16))
    queries[0] = vectors[5]
    df = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id int, query array<double>")
    rows = K.topk_batch(index, df, 6, metric).orderBy("query_id", "rank").collect()
    all_vectors = vectors if metric == "cosine" else with_origin(vectors)
    for i, q in enumerate(queries):
        mine = [r["id"] for r in rows if r["query_id"] == i]
        assert mine == brute(all_vectors, q, 6, metric)
    assert [r["rank"] for r in rows[:6]] == [1, 2, 3, 4, 5, 6]


def test_batch_text_ids_large_k_and_no_queries(spark, corpus):
    index, vectors = corpus
    df = spark.createDataFrame([("a", vectors[0].tolist())], "query_id string, query array<double>")
    rows = K.topk_batch(index, df, 1000, id_col="name").orderBy("rank").collect()
    assert len(rows) == 400
    assert [r["id"] for r in rows[:2]] == ["id0000", "id0300"]
    assert K.topk_batch(index, df.limit(0), 3).count() == 0


def test_filter_applies_before_the_cut(corpus):
    index, vectors = corpus
    q = np.random.default_rng(1).normal(size=16)
    conditions = {"grp": {"$eq": 2}, "price": {"$lt": 200}}
    found = [r["id"] for r in K.topk(index, q.tolist(), 5, conditions=conditions).collect()]
    assert found == brute(vectors, q, 5, "cosine", lambda i: i % 5 == 2 and i < 200)
    for nothing in (None, {}):
        same = [r["id"] for r in K.topk(index, q.tolist(), 5, conditions=nothing).collect()]
        assert same == brute(vectors, q, 5, "cosine")


def test_filter_on_dynamic_metadata(spark):
    lines = ['{"c":"x","p":5}', '{"c":"x","p":"5"}', '{"c":5,"p":1}', '{"p":1}', '{"c":"y","p":2.5,"b":true}']
    df = spark.createDataFrame(list(enumerate(lines)), "id int, j string").select(
        "id", F.from_json("j", "map<string,variant>").alias("metadata"))

    def ids(conditions):
        return [r["id"] for r in df.filter(compile_filter(conditions, df.columns)).orderBy("id").collect()]

    assert ids({"c": {"$eq": "x"}}) == [0, 1]
    assert ids({"c": "x"}) == [0, 1]
    assert ids({"p": {"$lt": 5}}) == [2, 3, 4]
    assert ids({"p": {"$gte": 2, "$lte": 5}}) == [0, 4]
    assert ids({"c": {"$in": ["y", "z"]}, "b": {"$eq": True}}) == [4]
    assert ids({"c": {"$nin": ["y"]}}) == [0, 1]
    assert ids({"p": {"$ne": 1}, "c": {"$ne": "y"}}) == [0]
    assert ids({"p": {"$gt": 1}}) == [0, 4]
    assert ids({}) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        compile_filter({"p": {"$near": 1}}, [])


def test_ann_recall(corpus):
    index, vectors = corpus
    hits = total = 0
    for seed in range(3):
        q = np.random.default_rng(seed).normal(size=16)
        found = {r["id"] for r in K.topk_ann(index.filter("size(embedding) = 16"), q.tolist(), 10).collect()}
        hits += len(found & set(brute(vectors, q, 10, "cosine")))
        total += 10
    assert hits / total >= 0.6


def test_plans(spark, corpus, tmp_path):
    index, vectors = corpus
    path = str(tmp_path / "t")
    index.write.parquet(path)
    stored = spark.read.parquet(path)
    plan = K.topk(stored, vectors[0].tolist(), 5, conditions={"price": {"$lt": 10}}, kernel="jvm")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text and "Python" not in text
    assert "LessThan(price,10.0)" in text and "name:string" not in text
    queries = spark.createDataFrame([(1, vectors[0].tolist())], "query_id int, query array<double>")
    batch = K.topk_batch(stored, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in batch and "NestedLoop" not in batch and "Cartesian" not in batch


def test_present(spark):
    metadata = {"image_url": "u", "embedding": "e", "a": "1", "long": "x" * 100, "edge": "y" * 99}
    df = spark.createDataFrame([("p", 0.5, metadata), ("q", 0.98765, {"a": "2"})],
                               "id string, score double, metadata map<string,string>")
    first, second = K.present(df).orderBy("rank").collect()
    assert (first["rank"], first["id"], first["score_text"], first["image_url"]) == (1, "q", "0.9877", None)
    assert (second["image_url"], second["shown"]) == ("u", {"a": "1", "edge": "y" * 99})


def test_attach_metadata(corpus):
    index, vectors = corpus
    found = K.topk(index, vectors[7].tolist(), 3)
    rows = K.attach_metadata(found, index.drop("embedding"), "id").collect()
    assert len(rows) == 3 and all(r["name"] == f"id{r['id']:04d}" for r in rows)


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("k", [2, 3, 10])
def test_odd_vectors_get_one_answer_from_every_kernel(spark, metric, k):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [0.2, -1.0]), (2, [0.9, 0.6]), (3, [3.0, 1.0]), (4, [inf, 1.0]), (5, [nan, 1.0]), (6, [-inf, inf]),
            (7, [0.0, 0.0]), (8, [1.0]), (9, None), (10, [None, 1.0]), (11, [1e200, 1e200]), (12, [])]
    index = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    q = [1.0, 0.4]
    usable = {i: np.array(rows[i][1]) for i in ((0, 1, 2, 3) if metric == "cosine" else (0, 1, 2, 3, 7))}
    if metric == "cosine":
        order = sorted(usable, key=lambda i: -float(usable[i] @ q) / np.linalg.norm(usable[i]))
    else:
        order = sorted(usable, key=lambda i: np.linalg.norm(usable[i] - q))
    for kernel in ("jvm", "arrow"):
        assert [r["id"] for r in K.topk(index, q, k, metric, kernel=kernel).collect()] == order[:k]
    queries = spark.createDataFrame([(1, q), (2, [nan, 1.0]), (3, None)], "query_id int, query array<double>")
    found = K.topk_batch(index, queries, k, metric).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in found] == [(1, i) for i in order[:k]]


@pytest.mark.parametrize(("scale", "shift"), [(1e-7, 0.0), (1.0, 1e6), (1e90, 0.0)])
@pytest.mark.parametrize("block_bytes", [K.BLOCK_BYTES, 500])
def test_batch_distances_of_any_size(spark, monkeypatch, scale, shift, block_bytes):
    monkeypatch.setattr(K, "BLOCK_BYTES", block_bytes)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(200, 8)) * scale + shift
    queries = rng.normal(size=(6, 8)) * scale + shift
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    df = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id int, query array<double>")
    found = K.topk_batch(index, df, 5, "euclidean").orderBy("query_id", "rank").collect()
    for i, q in enumerate(queries):
        distances = np.sqrt(np.square(vectors - q).sum(axis=1))
        best = np.lexsort((np.arange(200), distances))[:5]
        mine = [r for r in found if r["query_id"] == i]
        assert [r["id"] for r in mine] == best.tolist()
        assert [r["score"] for r in mine] == distances[best].tolist()
        single = K.topk(index, q.tolist(), 5, "euclidean").collect()
        assert [(r["id"], r["score"]) for r in single] == [(r["id"], r["score"]) for r in mine]


def test_index_rows_move_alike_for_any_number_of_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(K, "PART_BYTES", 10_000)
    index, vectors = corpus
    df = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(300)], "query_id int, query array<double>")
    moved = []
    inner = K.search_visits

    def counted(rows, visits, *rest):
        moved.append((rows.count(), visits.count()))
        return inner(rows, visits, *rest)

    monkeypatch.setattr(K, "search_visits", counted)
    results = []
    for block_bytes in (40_000, 700):  # one block of queries, and some 60 of them
        monkeypatch.setattr(K, "BLOCK_BYTES", block_bytes)
        results.append(sorted(map(tuple, K.topk_batch(index, df, 3, by_cells=True).collect())))
    assert results[0] == results[1] and len(results[0]) == 900
    assert moved[:2] == moved[2:] and {m[0] for m in moved} == {400} and moved[0][1] == 300


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("cells", [K._CELLS, 200])
def test_many_queries_of_a_small_index_stay_where_they_are(spark, corpus, monkeypatch, metric, cells):
    index, vectors = corpus
    queries = np.random.default_rng(4).normal(size=(90, 16))
    queries[:20] = vectors[:20]
    odd = [(90, [0.0] * 16), (91, [float("nan")] * 16), (92, None), (93, [None] * 16), (None, [1.0] * 16), (94, [2.0])]
    df = spark.createDataFrame([*((i, q.tolist()) for i, q in enumerate(queries)), *odd], "query_id int, query array<double>").repartition(3)
    monkeypatch.setattr(K, "BLOCK_BYTES", 10_000)  # less than the queries, and an eighth of it more than the index
    monkeypatch.setattr(K, "_CELLS", cells)
    with monkeypatch.context() as patched:
        patched.setattr(K, "search_visits", lambda *_: pytest.fail("queries moved"))
        result = K.topk_batch(index, df, 6, metric)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Exchange" not in plan.split("MapInArrow")[1]
        found = sorted(map(tuple, result.collect()))
    all_vectors = vectors if metric == "cosine" else with_origin(vectors)
    for i, q in enumerate(queries):
        assert [r[2] for r in found if r[0] == i] == brute(all_vectors, q, 6, metric)
    # the only vector of length one is the only result of the query of that length
    assert [r for r in found if r[0] == 94] == [(94, 1, 402, 1.0)]
    assert not [r for r in found if r[0] in (91, 92, 93, None)]
    assert len([r for r in found if r[0] == 90]) == (0 if metric == "cosine" else 6)
    by_cells = sorted(map(tuple, K.topk_batch(index, df, 6, metric, by_cells=True).collect()))
    assert [r for r in found if r[0] != 94] == by_cells
    assert K.topk_batch(index.limit(0), df, 3, metric).count() == 0


def test_cosines_that_single_precision_cannot_tell_apart(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=32)
    vectors = base + rng.normal(size=(300, 32)) * 1e-6
    queries = base + rng.normal(size=(40, 32)) * 1e-6
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    df = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id int, query array<double>")
    results = []
    for block_bytes, by_cells in ((K.BLOCK_BYTES, None), (12_000, None), (12_000, True)):
        monkeypatch.setattr(K, "BLOCK_BYTES", block_bytes)
        results.append(sorted(map(tuple, K.topk_batch(index, df, 4, by_cells=by_cells).collect())))
    assert results[0] == results[1] == results[2]
    for i, q in enumerate(queries[:5]):
        single = [(r["id"], r["score"]) for r in K.topk(index, q.tolist(), 4).collect()]
        assert [(r[2], r[3]) for r in results[0] if r[0] == i] == single


def test_cells_far_away_are_not_visited(spark, monkeypatch):
    """Clustered vectors: a query visits its own cluster and little else."""
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 8)) * 100
    vectors = np.vstack([c + rng.normal(size=(60, 8)) for c in centers])
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<double>")
    df = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 720, 9)], "query_id int, query array<double>")
    visits = []
    inner = K.search_visits
    monkeypatch.setattr(K, "search_visits", lambda rows, v, *rest: (visits.append(v.count()), inner(rows, v, *rest))[1])
    found = K.topk_batch(index, df, 5, "euclidean", by_cells=True).collect()
    for q in range(0, 720, 9):
        assert [r["id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == brute(vectors, vectors[q], 5, "euclidean")
    assert visits[0] == 80 and visits[1] < 80 * 4


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_inverted_file(spark, corpus, tmp_path, metric):
    index, vectors = corpus
    file = ivf.build(index, str(tmp_path / "f"), 16, metric, recall=0.95)
    assert file.rows.count() == 403 and 1 <= file.probes <= 16
    df = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(0, 400, 5)], "query_id int, query array<double>")
    found = ivf.search_batch(file, df, 10).collect()
    exact = {(r["query_id"], r["id"]) for r in K.topk_batch(index, df, 10, metric).collect()}
    assert len(exact & {(r["query_id"], r["id"]) for r in found}) >= 0.9 * len(exact)
    one = ivf.search(file, vectors[0].tolist(), 10)
    assert {r["id"] for r in one.collect()} == {r["id"] for r in found if r["query_id"] == 0}
    plan = ivf.search(file, vectors[0].tolist(), 10, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "hash" not in plan.split("PartitionFilters")[1].split("ReadSchema")[0]
    everything = ivf.search(file, vectors[7].tolist(), 10, probes=16).collect()
    assert [r["id"] for r in everything] == brute(vectors if metric == "cosine" else with_origin(vectors), vectors[7], 10, metric)
    assert ivf.search(file, [0.0] * 3, 5).collect() == [] == ivf.search_batch(file, df.limit(0), 5).collect()


def test_inverted_file_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([(1, None), (2, [])], "id long, embedding array<double>")
    for n, index in enumerate((empty, empty.limit(0))):
        file = ivf.build(index, str(tmp_path / str(n)))
        assert ivf.search(file, [1.0], 5).collect() == []


def test_empty_lists_and_own_names_in_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, t string")
    count = lambda c: df.filter(compile_filter(c, df.columns)).count()
    assert (count({"t": {"$in": []}}), count({"t": {"$nin": []}})) == (0, 2)
    index = spark.createDataFrame([("x", [1.0])], "id string, embedding array<double>").withColumn(
        "metadata", F.expr("try_variant_get(to_variant_object(named_struct('id', 'inner', 'n', 1)), '$', 'map<string,variant>')"))
    found = lambda c: index.filter(compile_filter(c, index.columns)).count()
    assert (found({"id": {"$eq": "inner"}}), found({"id": {"$eq": "x"}})) == (1, 0)
    assert (found({"n": {"$in": []}}), found({"n": {"$nin": []}})) == (0, 1)
