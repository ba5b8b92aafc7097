import pytest
from pyspark.sql import functions as F

from vitrine.operators import joins as J
from vitrine.operators.keyed import keep_first, keep_last, upsert


@pytest.fixture
def no_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_a_repeated_key_of_the_lookup_side_raises(spark):
    big = spark.createDataFrame([(1, "a")], "n int, key string")
    small = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), (None, 4)], "key string, v int")
    with pytest.raises(ValueError, match="'a' occurs 2 times"):
        J.lookup(big, small, "key")
    assert J.lookup(big, small.filter("v <> 2"), "key").first()["v"] == 1


def test_wide_hot_matches_are_dealt_over_salts(spark, monkeypatch, no_broadcast):
    """A key with a third of the rows and a match too wide to broadcast: no task gets twice the median."""
    monkeypatch.setattr(J, "HOT_FLOOR", 10)
    monkeypatch.setattr(J, "HOT_SHARE", 0.01)
    keys = ["hot"] * 1000 + ["warm"] * 300 + [f"k{i}" for i in range(1700)] + [None] * 50
    big = spark.createDataFrame(list(enumerate(keys)), "n int, key string")
    small = spark.createDataFrame([("hot", "x" * 1000), ("warm", "y"), ("k5", "z"), ("idle", "w")], "key string, v string")
    narrow = J.lookup(big, small, "key")
    monkeypatch.setattr(J, "HOT_BYTES", 10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        wide = J.lookup(big, small, "key")
        plan = wide._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(key" in plan and "_salt" in plan
        per_task = [r["count"] for r in wide.filter("key = 'hot'").groupBy(F.spark_partition_id()).count().collect()]
        assert len(per_task) == 4 and max(per_task) <= 2 * sorted(per_task)[1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(map(str, wide.collect())) == sorted(map(str, narrow.collect()))
    assert wide.filter("found").count() == 1301 and wide.count() == len(keys)


def test_failed_copies(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c"), (5, "b")], "line_no int, image_url string")
    copies = spark.createDataFrame([("a", False, None), ("a", True, "A"), ("b", False, "B"), (None, False, "x"), ("b", None, None)],
                                   "src_url string, ok boolean, new_url string")
    found = J.failed_copies(records, copies).collect()
    assert sorted((r["line_no"], r["image_url"], r["reason"]) for r in found) == [(2, "b", "asset_unavailable"), (5, "b", "asset_unavailable")]


@pytest.mark.parametrize("hot_floor", [J.HOT_FLOOR, 10])
@pytest.mark.parametrize("broadcast", [True, False])
def test_lookup_equals_a_left_join(spark, monkeypatch, request, hot_floor, broadcast):
    monkeypatch.setattr(J, "HOT_FLOOR", hot_floor)
    if not broadcast:
        request.getfixturevalue("no_broadcast")
    keys = ["hot"] * 300 + [f"k{i}" for i in range(200)] + [None] * 100 + ["lost"] * 50
    big = spark.createDataFrame(list(enumerate(keys)), "n int, key string").repartition(4)
    small = spark.createDataFrame(
        [("hot", 1, None)] + [(f"k{i}", i, f"v{i}") for i in range(0, 400, 2)] + [(None, -1, "null")],
        "key string, a int, b string",
    )
    rows = {r["n"]: (r["a"], r["b"], r["found"]) for r in J.lookup(big, small, "key").collect()}
    assert len(rows) == len(keys)
    for n, key in enumerate(keys):
        if key == "hot":
            expected = (1, None, True)
        elif key and key[0] == "k" and int(key[1:]) % 2 == 0:
            expected = (int(key[1:]), f"v{key[1:]}", True)
        else:
            expected = (None, None, False)
        assert rows[n] == expected
    hot = {r["key"] for r in J.hot_keys(big, "key").collect()}
    assert hot == ({"hot", "lost"} if hot_floor == 10 else set())


def test_url_rewrite(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a"), (5, "")], "n int, image_url string")
    copies = spark.createDataFrame([("a", True, "A"), ("b", False, "B"), ("c", True, "C")], "src_url string, ok boolean, new_url string")
    rows = {r["n"]: r["image_url"] for r in J.rewrite_urls(records, copies).collect()}
    assert rows == {1: "A", 2: "b", 3: None, 4: "A", 5: ""}


def test_manifest_reports_collisions(spark):
    urls = ["http://x/a.jpg", "http://y/a.jpg", "http://x/a.jpg", "http://x/b.jpg", "", None]
    records = spark.createDataFrame(list(enumerate(urls)), "n int, image_url string")
    rows = {r["dest"]: (r["src_url"], r["n_sources"], r["collides"]) for r in J.asset_manifest(records, "images/", "n").collect()}
    assert rows == {
        "images/a.jpg": ("http://x/a.jpg", 2, True),
        "images/b.jpg": ("http://x/b.jpg", 1, False),
    }


def test_attach_embedding(spark):
    records = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "n int, id string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, embedding array<double>")
    good, rejects = J.attach_embedding(records, vectors, "id")
    assert [(r["n"], r["embedding"]) for r in good.collect()] == [(1, [1.0])]
    assert sorted((r["n"], r["reason"]) for r in rejects.collect()) == [(2, "embedding_failed"), (3, "embedding_failed")]


def test_one_row_per_key(spark):
    rows = [("a", 1, "x", None), ("a", 2, None, {"k": "v"}), ("b", 3, "y", None)]
    df = spark.createDataFrame(rows, "id string, n int, s string, m map<string,string>")
    assert sorted((r["id"], r["n"], r["s"]) for r in keep_last(df, "id", "n").collect()) == [("a", 2, None), ("b", 3, "y")]
    assert sorted((r["id"], r["n"], r["s"]) for r in keep_first(df, "id", "n").collect()) == [("a", 1, "x"), ("b", 3, "y")]
    both = keep_last(df.withColumn("z", F.lit(1)), ["id", "z"], "z", "n")
    assert both.columns == ["id", "n", "s", "m", "z"] and both.count() == 2


def test_upsert(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    updates = spark.createDataFrame([("b", 9, 2), ("b", 8, 1), ("c", 7, 1)], "id string, v int, n int")
    done = upsert(base, updates, "id", "n")
    assert sorted(tuple(r) for r in done.collect()) == [("a", 1), ("b", 9), ("c", 7)]
    again = upsert(done, updates, "id", "n")
    assert sorted(tuple(r) for r in again.collect()) == [("a", 1), ("b", 9), ("c", 7)]


def test_only_keys_and_order_are_aggregated(spark, tmp_path):
    """Wide columns reach no aggregate and no sort-based one is needed."""
    path = str(tmp_path / "t")
    spark.range(100).select((F.col("id") % 3).alias("k"), "id", F.array("id").alias("wide")).write.parquet(path)
    plan = keep_last(spark.read.parquet(path), "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(id" in plan and "SortAggregate" not in plan
    assert all("wide" not in line for line in plan.splitlines() if "Aggregate" in line)


def test_null_order_loses(spark):
    rows = [("a", None, "null"), ("a", 1, "x"), ("a", 3, "z"), ("b", None, "only"), (None, 2, "no key"), (None, 5, "no key 5")]
    df = spark.createDataFrame(rows, "id string, n int, s string")
    assert {r["s"] for r in keep_last(df, "id", "n").collect()} == {"z", "only", "no key 5"}
    assert {r["s"] for r in keep_first(df, "id", "n").collect()} == {"x", "only", "no key"}
    pairs = df.withColumn("m", F.lit(1))
    assert {r["s"] for r in keep_last(pairs, "id", "n", "m").collect()} == {"z", "only", "no key 5"}
    assert {r["s"] for r in keep_first(pairs, "id", "n", "m").collect()} == {"x", "only", "no key"}
