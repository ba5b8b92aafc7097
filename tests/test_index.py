import os
import re

import pytest
from pyspark.sql import functions as F

from vitrine.operators.topk import topk
from vitrine.sources import index_store as S
from vitrine.sources.commits import CommitLog
from vitrine.sources.index_store import ensure_index, open_index


def entries(spark, rows):
    df = spark.createDataFrame(rows, "id string, embedding array<double>, note string, n long")
    metadata = F.try_variant_get(F.to_variant_object(F.struct("note", "n")), "$", "map<string,variant>")
    return df.withColumn("metadata", metadata)


def content(index):
    note = F.try_variant_get(F.try_element_at("metadata", F.lit("note")), "$", "string")
    rows = index.read().select("id", "embedding", note.alias("note")).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: (r["embedding"], r["note"]) for r in rows}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet"))


def test_lifecycle(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        open_index(spark, root, "idx")
    index = ensure_index(spark, root, "idx", 2)
    assert (index.generation(), index.read().count(), index.last_batch("s")) == (0, 0, None)
    assert ensure_index(spark, root, "idx", 2) == index
    for other in ({"dim": 3}, {"dim": 2, "metric": "euclidean"}, {"dim": 2, "filters": {"n": "double"}}):
        with pytest.raises(ValueError):
            ensure_index(spark, root, "idx", **other)
    for wrong in ({"metric": "other"}, {"filters": {"id": "string"}}, {"filters": {"n": "map"}}):
        with pytest.raises(ValueError):
            ensure_index(spark, root, "new", 2, **wrong)

    first = [(f"i{k}", [float(k), 1.0], "old", k) for k in range(20)]
    assert index.upsert(entries(spark, first), "n") == 1
    before = index.read()
    updates = entries(spark, [("i3", [9.0, 9.0], "late", 2), ("i3", [8.0, 8.0], "early", 1), ("new", [0.0, 1.0], "x", 1),
                              ("new", [5.0, 5.0], "null order loses", None)])
    assert index.upsert(updates, "n") == 2
    expected = {f"i{k}": ([float(k), 1.0], "old") for k in range(20)}
    expected |= {"i3": ([9.0, 9.0], "late"), "new": ([0.0, 1.0], "x")}
    assert content(index) == expected
    assert before.count() == 20  # a reader of the older generation is undisturbed
    assert sorted(r["id"] for r in index.entries_of(spark.createDataFrame([("i3",), ("i9",), ("no",)], "id string")).collect()) == ["i3", "i9"]
    index.compact(full=False)
    assert content(index) == expected
    index.compact()
    assert content(open_index(spark, root, "idx")) == expected
    index.upsert(entries(spark, [("i4", [0.0, 0.0], "again", 0)]), "n")
    expected["i4"] = ([0.0, 0.0], "again")
    index.expire()
    assert content(index) == expected
    assert len(os.listdir(tmp_path / "idx" / "data")) == 2


def test_merging_many_deltas_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MAX_DELTAS", 2)
    index = ensure_index(spark, str(tmp_path), "idx", 1)
    expected = {}
    for k in range(8):
        rows = [(f"i{j}", [float(k)], f"v{k}", 100 - k) for j in range(k, k + 4)]
        index.upsert(entries(spark, rows), "n")
        expected |= {r[0]: (r[1], r[2]) for r in rows}
        assert content(index) == expected
    folders = CommitLog(spark, f"{index.path}/commits").latest()[1]["folders"]
    assert len(folders) <= 4


def test_a_small_upsert_writes_little(spark, tmp_path):
    index = ensure_index(spark, str(tmp_path), "idx", 64)
    vector = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.rand(3) * i)
    metadata = F.try_variant_get(F.to_variant_object(F.struct("n")), "$", "map<string,variant>")
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), vector.alias("embedding"), F.col("id").alias("n")).withColumn("metadata", metadata)
    index.upsert(rows, "n")
    whole = size(index.path)
    index.upsert(rows.filter("n % 1000 = 0"), "n")
    assert size(index.path) - whole < whole / 100
    assert index.read().count() == 20_000


def test_conditions_on_promoted_fields_reach_the_scan(spark, tmp_path):
    index = ensure_index(spark, str(tmp_path), "idx", 1, filters={"note": "string", "n": "double"})
    index.upsert(entries(spark, [(f"i{k}", [1.0 + k], "ab"[k % 2], k) for k in range(20)]), "n")
    found = topk(index.read(), [1.0], 50, conditions={"note": {"$eq": "a"}, "n": {"$lt": 9}})
    assert sorted(r["id"] for r in found.collect()) == ["i0", "i2", "i4", "i6", "i8"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(note,a\)[^\]]*LessThan\(n,9", plan)
    index.upsert(entries(spark, [("i0", [1.0], "b", 0)]), "n")
    found = topk(index.read(), [1.0], 50, conditions={"note": {"$eq": "a"}, "n": {"$lt": 9}})
    assert sorted(r["id"] for r in found.collect()) == ["i2", "i4", "i6", "i8"]


def test_wrong_dimension_is_refused_and_nothing_shows(spark, tmp_path):
    index = ensure_index(spark, str(tmp_path), "idx", 2)
    index.upsert(entries(spark, [("a", [1.0, 2.0], "x", 1)]), "n")
    with pytest.raises(Exception, match="2 dimensions"):
        index.upsert(entries(spark, [("b", [1.0], "x", 1)]), "n")
    assert list(content(index)) == ["a"]


def test_an_unfinished_commit_blocks_nobody(spark, tmp_path):
    index = ensure_index(spark, str(tmp_path), "idx", 1)
    index.upsert(entries(spark, [("a", [1.0], "x", 1)]), "n")
    (tmp_path / "idx" / "commits" / "2.json").write_text('{"folders": [{"fol')
    (tmp_path / "idx" / "commits" / "3.json").mkdir()
    assert index.generation() == 1 and list(content(index)) == ["a"]
    (tmp_path / "idx" / "data" / "delta-lost").mkdir(parents=True)  # of a failed upsert, never read
    assert index.upsert(entries(spark, [("b", [1.0], "y", 1)]), "n") == 4
    assert sorted(content(index)) == ["a", "b"]


def test_of_two_writers_none_is_lost(spark, tmp_path):
    index = ensure_index(spark, str(tmp_path), "idx", 1)
    log = CommitLog(spark, f"{index.path}/commits")
    seen = []

    def change(number, content):
        seen.append(number)
        if len(seen) == 1:  # another writer commits in between
            index.upsert(entries(spark, [("a", [1.0], "x", 1)]), "n")
        return {**content, "mark": True}

    log.append(change)
    assert seen == [1, 2] and log.latest()[1]["mark"] and list(content(index)) == ["a"]


def test_empty_upsert(spark, tmp_path):
    index = ensure_index(spark, str(tmp_path), "idx", 1)
    assert index.upsert(entries(spark, []), "n") == 0
