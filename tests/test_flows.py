import json

import pytest
from pyspark.sql import functions as F

from vitrine.functions.dynamic import text_field
from vitrine.plans.flows import check_lines, full_entries, records_from_pages, search, search_index, simple_entries
from vitrine.sources.index_store import ensure_index

LINES = [
    '{"name":"A é’","edition":"Limited Edition  418","release_date":"2011-11-02","image_url":"http://h/a.jpg","tags":["x"]}',
    '{"name":null,"image_url":null}',
    '{"image_url":"http://h/a.jpg"}',
    '{"name":"B","image_url":""}',
    "not json",
    "",
    '[{"name":"A"}]',
    '{"name":"C","image_url":"u","release_date":20201234}',
    '{"name":"D","image_url":"u","release_date":"Unknown"}',
    '{"name":"E","image_url":"u","n":1,"f":1.5,"b":true,"z":null,"o":{"a":1},"tags":[]}',
    '{"name":"Á","image_url":"u"}',
    '{"name":"A","image_url":"v"}',
    '{"name":"lost","image_url":"nowhere"}',
    '{"name":"short","image_url":"short"}',
    '{"name":"flat","image_url":"flat"}',
]
VECTORS = [("http://h/a.jpg", [1.0, 2.0, 0.0, 0.0]), ("u", [0.0, 0.0, 2.0, 1.0]), ("v", [2.0, 0.0, 0.0, 1.0]),
           ("short", [1.0]), ("flat", [0.0] * 4)]
REJECTS = {2: "missing_id", 3: "missing_id", 4: "missing_image_url", 5: "invalid_json", 6: "invalid_json",
           7: "not_an_object", 13: "embedding_failed", 14: "bad_dimension", 15: "zero_norm"}


@pytest.fixture
def inputs(spark):
    lines = spark.createDataFrame(list(enumerate(LINES, 1)), "line_no long, raw string")
    vectors = spark.createDataFrame(VECTORS, "image_url string, embedding array<double>")
    return lines, vectors


def constant():
    def make_model():
        return lambda texts, variants: [[1.0, 1.0, 1.0, 1.0 + len(t)] for t in texts]

    return make_model


def test_check_lines(inputs):
    rows = {r["line_no"]: r for r in check_lines(inputs[0]).withColumn("j", F.to_json("fields")).collect()}
    assert rows[1]["id"] == "A e"
    first = json.loads(rows[1]["j"])
    assert (first["edition"], first["release_date"]) == ("LE 418", "2011")
    assert json.loads(rows[8]["j"])["release_date"] == 20201234
    assert json.loads(rows[9]["j"])["release_date"] == "Unknown"


def test_simple(inputs):
    entries, rejects = simple_entries(*inputs, dim=4)
    rows = {r["id"]: r for r in entries.withColumn("keys", F.map_keys("metadata")).collect()}
    assert set(rows) == {"A e", "C", "D", "E", "A"}
    assert rows["A"]["line_no"] == 12  # the last of two colliding ids
    assert sorted(rows["E"]["keys"]) == ["b", "f", "image_url", "n", "name"]
    bad = rejects.collect()
    assert {r["line_no"]: r["reason"] for r in bad} == REJECTS
    assert all(r["raw"] == LINES[r["line_no"] - 1] for r in bad)


def test_full(inputs):
    entries, rejects = full_entries(*inputs, constant(), dim=4, top_m=2)
    rows = {r["id"]: r for r in entries.collect()}
    # C, D, E and the first A share image "u": only C stays, so the second A is free.
    assert {i: r["line_no"] for i, r in rows.items()} == {"A e": 1, "C": 8, "A": 12}
    assert rows["C"]["embedding"] == pytest.approx([0.3, 0.3, 1.7, 1.0])
    assert sorted(rows["A e"]["metadata"]) == ["edition", "name", "release_date", "tags"]
    reasons = {r["line_no"]: r["reason"] for r in rejects.collect()}
    assert reasons == REJECTS | {9: "near_duplicate", 10: "near_duplicate", 11: "near_duplicate"}


def test_repeated_id_of_a_kept_row(spark):
    raw = [json.dumps({"name": "X", "image_url": u}) for u in ("a", "b", "c")] + [json.dumps({"name": "Y", "image_url": "b"})]
    lines = spark.createDataFrame(list(enumerate(raw, 1)), "line_no long, raw string")
    vectors = spark.createDataFrame(
        [("a", [1.0, 2.0, 0.0, 0.0]), ("b", [0.0, 0.0, 2.0, 1.0]), ("c", [2.0, 0.0, 0.0, 1.0])],
        "image_url string, embedding array<double>")
    entries, rejects = full_entries(lines, vectors, constant(), 4, 2)
    # A refused id is not inserted, so Y with the same image as the refused X is kept.
    assert {r["line_no"] for r in entries.collect()} == {1, 4}
    assert {r["line_no"]: r["reason"] for r in rejects.collect()} == {2: "duplicate_id", 3: "duplicate_id"}


def test_search(inputs):
    entries, _ = simple_entries(*inputs, dim=4)
    shown = search(entries, [0.0, 0.0, 2.0, 1.0], 3, conditions={"release_date": "Unknown"}).collect()
    assert [(r["rank"], r["id"], r["score_text"], r["image_url"]) for r in shown] == [(1, "D", "1.0000", "u")]
    assert shown[0]["shown"] == {"name": "D", "release_date": "Unknown"}
    assert [r["id"] for r in search(entries, [0.0, 0.0, 2.0, 1.0], 2).orderBy("rank").collect()] == ["C", "D"]


def test_pages_to_records(spark):
    html = '<h1 class="h3">n</h1><table class="table table-bordered"><td>Edition</td><td>Limited Edition  5</td></table>'
    row = records_from_pages(spark.createDataFrame([(html,)], "html string")).first()
    assert (row["name"], row["edition"], row["release_date"], row["tags"]) == ("n", "LE 5", None, [])


def test_id_field_is_a_parameter(spark):
    lines = spark.createDataFrame([(1, '{"id":"k","image_url":"u"}')], "line_no long, raw string")
    assert check_lines(lines, id_field="id").select("id", "reason").first() == ("k", None)
    assert lines.select(text_field(F.from_json("raw", "map<string,variant>"), "id")).first()[0] == "k"


def test_search_of_a_stored_index(spark, inputs, tmp_path):
    entries, _ = simple_entries(*inputs, dim=4)
    index = ensure_index(spark, str(tmp_path), "idx", 4)
    index.upsert(entries, "line_no")
    for conditions in (None, {"release_date": "Unknown"}):
        stored = search_index(index, [0.0, 0.0, 2.0, 1.0], 3, conditions).orderBy("rank").collect()
        assert stored == search(entries, [0.0, 0.0, 2.0, 1.0], 3, conditions=conditions).orderBy("rank").collect()
    with pytest.raises(ValueError):
        search_index(index, [1.0])


def test_counts_of_the_job_that_writes(spark, tmp_path):
    """Good, rejected and strange rows in one job; equal to an aggregate over what was written."""
    from vitrine.operators.validate import count_by, write_judged

    rows = [(i, [None, "missing_id", "invalid_json", "odd reason"][i % 4]) for i in range(103)]
    judged = spark.createDataFrame(rows, "n int, reason string").repartition(4)
    context = spark.sparkContext
    context.setJobGroup("judged", "write")
    counts = write_judged(judged, str(tmp_path / "j"))
    jobs = context.statusTracker().getJobIdsForGroup("judged")
    context.setLocalProperty("spark.jobGroup.id", None)
    written = spark.read.parquet(str(tmp_path / "j"))
    again = {r["status"]: r["n"] for r in count_by(written, F.coalesce("reason", F.lit("good"))).collect()}
    assert {k: n for k, n in counts.items() if n} == {("other" if k == "odd reason" else k): n for k, n in again.items()}
    assert len(jobs) <= 2  # with adaptive execution the shuffle of the input is a job of its own
    assert {r["rejected"] for r in written.filter("reason IS NULL").collect()} == {"false"}
    assert set(write_judged(judged.limit(0), str(tmp_path / "none")).values()) == {0}
