import random

from pyspark.sql import functions as F

from test_flows import LINES
from vitrine.operators.neardup import drop_near_dups
from vitrine.plans.flows import check_lines
from vitrine.session import list_children, scratch_root
from vitrine.sources.index_store import ensure_index
from vitrine.streaming import upsert as U
from vitrine.streaming.ingest import run_available, stream_records
from vitrine.streaming.upsert import drop_near_dups_in_batch, stream_drop_near_dups, stream_upsert


def test_stream_equals_batch(spark, tmp_path):
    arrivals = tmp_path / "in"
    arrivals.mkdir()
    paths = [str(tmp_path / name) for name in ("state", "out")]
    for n, part in enumerate((LINES[:4], LINES[4:9], LINES[9:])):
        (arrivals / f"{n}.jsonl").write_text("\n".join(part) + "\n")
        stream = stream_records(spark, str(arrivals)).select("raw", "id", "reason")
        run_available(stream, *paths)
    out = spark.read.parquet(paths[1]).collect()
    lines = spark.createDataFrame(list(enumerate(LINES)), "line_no long, raw string")
    batch = check_lines(lines).select("raw", "id", "reason").collect()
    key = lambda r: (r["raw"], str(r["id"]))
    assert sorted(out, key=key) == sorted(batch, key=key)


def vector_stream(spark, folder):
    return spark.readStream.schema("id string, n long, x double").json(folder).select(
        "id", "n", F.array("x").alias("embedding"),
        F.from_json(F.lit("{}"), "map<string,variant>").alias("metadata"))


def test_stream_upsert_and_replay(spark, tmp_path):
    folder = str(tmp_path / "in")
    index = ensure_index(spark, str(tmp_path), "idx", 1)
    for n in range(3):
        df = spark.createDataFrame([(f"i{k}", n * 10 + k, float(n)) for k in range(n, 6)], "id string, n long, x double")
        df.write.mode("append").json(folder)
        stream_upsert(vector_stream(spark, folder), index, "n", str(tmp_path / "state"))
    expected = {f"i{k}": [float(min(k, 2))] for k in range(6)}
    assert {r["id"]: r["embedding"] for r in index.read().collect()} == expected
    # A lost checkpoint replays everything as another stream, and no entry changes.
    stream_upsert(vector_stream(spark, folder), index, "n", str(tmp_path / "other-state"))
    assert {r["id"]: r["embedding"] for r in index.read().collect()} == expected
    index.compact()
    assert {r["id"]: r["embedding"] for r in index.read().collect()} == expected


def test_two_streams_into_one_index(spark, tmp_path):
    index = ensure_index(spark, str(tmp_path), "idx", 1)
    for name, rows in (("a", [("x", 5, 1.0), ("y", 1, 1.0)]), ("b", [("x", 4, 2.0), ("z", 1, 2.0), ("z", 1, 2.0)])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, "id string, n long, x double").write.json(folder)
        stream_upsert(vector_stream(spark, folder), index, "n", str(tmp_path / f"state-{name}"))
    assert {r["id"]: r["embedding"] for r in index.read().collect()} == {"x": [1.0], "y": [1.0], "z": [2.0]}
    assert index.read().count() == 3
    generation = index.generation()
    batch = spark.createDataFrame([("x", 9, 9.0)], "id string, n long, x double").select(
        "id", "n", F.array("x").alias("embedding"), F.from_json(F.lit("{}"), "map<string,variant>").alias("metadata"))
    index.upsert(batch, "n", "s", 0)
    assert index.upsert(batch.withColumn("n", F.lit(99)), "n", "s", 0) == generation + 1  # batch 0 of s is there


def random_rows(n):
    rng = random.Random(8)
    return [(i, [rng.randrange(60) for _ in range(rng.randint(0, 3))]) for i in range(n)]


def test_stream_near_dups_equal_the_batch_operator(spark, tmp_path):
    rows = random_rows(120)
    schema = "n long, b array<long>"
    folder, state, out = (str(tmp_path / name) for name in ("in", "buckets", "out"))
    for part in (rows[:30], rows[30:90], rows[90:]):
        spark.createDataFrame(part, schema).write.mode("append").json(folder)
        stream = spark.readStream.schema(schema).json(folder)
        stream_drop_near_dups(stream, "n", F.col("b"), state, out, str(tmp_path / "state"))
    assert not [p for p in list_children(spark, scratch_root(spark)) if p.startswith("scope")]
    streamed = {r["n"] for r in spark.read.schema(schema).parquet(out).collect()}
    kept, _ = drop_near_dups(spark.createDataFrame(rows, schema), "n", F.col("b"))
    assert streamed == {r["n"] for r in kept.collect()}


def test_replayed_batch_gives_the_same_rows(spark, tmp_path):
    rows = random_rows(60)
    state = str(tmp_path / "buckets")
    first, second = (spark.createDataFrame(part, "n long, b array<long>") for part in (rows[:30], rows[30:]))
    drop_near_dups_in_batch(first, "n", F.col("b"), state, 0)
    once = drop_near_dups_in_batch(second, "n", F.col("b"), state, 1).collect()
    # another stream comes in between, with rows that would collide
    drop_near_dups_in_batch(spark.createDataFrame([(999, list(range(60)))], "n long, b array<long>"), "n", F.col("b"), state, 0, "other")
    twice = drop_near_dups_in_batch(second, "n", F.col("b"), state, 1).collect()
    assert sorted(once) == sorted(twice)


def test_two_streams_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "MAX_FOLDERS", 1)
    schema = "n long, b array<long>"
    state, out = str(tmp_path / "buckets"), str(tmp_path / "out")
    parts = {"a": [(1, [1]), (2, [2, 3])], "b": [(3, [1]), (4, [4]), (5, None)], "c": [(6, [3]), (7, [4, 9]), (8, [9])]}
    for name, rows in parts.items():
        spark.createDataFrame(rows, schema).write.json(str(tmp_path / name))
        for _ in range(2):  # the second run finds nothing new
            stream = spark.readStream.schema(schema).json(str(tmp_path / name))
            stream_drop_near_dups(stream, "n", F.col("b"), state, out, str(tmp_path / f"state-{name}"))
    U.BucketState(spark, state).compact()
    U.BucketState(spark, state).expire()
    assert sorted(r["n"] for r in spark.read.schema(schema).parquet(out).collect()) == [1, 2, 4, 5, 8]
    batch = spark.createDataFrame([(10, [1]), (11, [4]), (12, [11])], schema)
    assert [r["n"] for r in drop_near_dups_in_batch(batch, "n", F.col("b"), state, 0, "d").collect()] == [12]
