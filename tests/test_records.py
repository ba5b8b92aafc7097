import json

import pytest
from pyspark.sql import functions as F

from vitrine.functions import dynamic as D
from vitrine.operators.numbering import MAX_BROADCAST_CHUNKS, expected_splits, split_bytes, with_batch_no, with_line_no
from vitrine.sources.pages import expand_ranges, listing_urls, read_pages
from vitrine.sources.records import classify_lines, parse_records, read_lines, read_records

LINES = [
    '{"name":"A é’","edition":"Limited Edition  418","release_date":"2011-11-02","image_url":"http://h/a.jpg","tags":["x"]}',
    '{"name":null,"image_url":null}',
    "not json",
    "",
    "[1]",
    '[{"name":"A"}]',
    '{"name":"F","name":"G","image_url":"u"}',
    '{"k":3} trailing',
    '{"k":3}} trailing',
    '{"a":1},"b":2',
    '{"k":1},"end":2',
    ' {"k": 3} ',
    "7",
    '"text"',
]
REASONS = [None, None, "invalid_json", "invalid_json", "not_an_object", "not_an_object",
           "invalid_json", "invalid_json", "invalid_json", "invalid_json", "invalid_json", None,
           "not_an_object", "not_an_object"]


def numbered(spark, lines):
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, raw string")


def test_reasons(spark):
    rows = classify_lines(numbered(spark, LINES)).orderBy("line_no").collect()
    assert [r["reason"] for r in rows] == REASONS


def test_policies(spark):
    good, bad = parse_records(numbered(spark, LINES))
    assert (good.count(), bad.count()) == (3, len(LINES) - 3)
    good, bad = parse_records(numbered(spark, LINES), "skip")
    assert (good.count(), bad.count()) == (3, 0)
    good, _ = parse_records(numbered(spark, LINES), "fail")
    with pytest.raises(Exception, match="invalid_json"):
        good.collect()
    good, _ = parse_records(numbered(spark, LINES[:2]), "fail")
    assert good.count() == 2
    with pytest.raises(ValueError):
        parse_records(numbered(spark, LINES), "other")


def test_typed_metadata(spark):
    line = '{"name":"E","n":1,"f":1.5,"b":true,"z":null,"o":{"a":1},"tags":[],"id":"i","description":null}'
    fields = classify_lines(numbered(spark, [line]))
    row = fields.select(
        F.map_keys(D.scalar_metadata(F.col("fields"))),
        F.map_keys(D.metadata_except(F.col("fields"))),
    ).first()
    assert sorted(row[0]) == ["b", "f", "id", "n", "name"]
    assert sorted(row[1]) == ["b", "f", "n", "name", "o", "tags", "z"]


def test_text_field_and_replace(spark):
    lines = ['{"d":20201234}', '{"d":"20201234"}', '{"d":null}', "{}"]
    fields = classify_lines(numbered(spark, lines))
    changed = D.replace_text(F.col("fields"), "d", lambda c: F.substring(c, 1, 4))
    rows = fields.select(F.to_json(changed), D.text_field(F.col("fields"), "d")).collect()
    assert [json.loads(r[0]) for r in rows] == [{"d": 20201234}, {"d": "2020"}, {"d": None}, {}]
    assert [r[1] for r in rows] == [None, "20201234", None, None]


@pytest.fixture
def tiny_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_line_numbers_across_splits_and_files(spark, tmp_path, tiny_splits):
    for name, n in (("a", 1000), ("b", 37)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{i}\r\n" for i in range(1, n + 1)))
    lines = read_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 2
    rows = lines.collect()
    assert len(rows) == 1037
    places = {r["raw"]: r["line_no"] for r in rows}
    expected = [f"a{i}" for i in range(1, 1001)] + [f"b{i}" for i in range(1, 38)]
    assert places == {line: n for n, line in enumerate(expected, 1)}


def test_numbering_along_columns(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").alias("b"))
    rows = with_line_no(df, "a", "b").collect()
    expected = {(a, b): n for n, (a, b) in enumerate(sorted((i % 7, i) for i in range(1000)), 1)}
    assert {(r["a"], r["b"]): r["line_no"] for r in rows} == expected


def test_batches(spark):
    df = spark.range(1, 301).withColumnRenamed("id", "line_no")
    sizes = with_batch_no(df).groupBy("batch_no").count().orderBy("batch_no").collect()
    assert [tuple(r) for r in sizes] == [(0, 128), (1, 128), (2, 44)]


def test_typed_scan(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(LINES[0] + "\n")
    row = read_records(spark, str(tmp_path)).first()
    assert (row["name"], row["tags"], row["sku"], row["raw"]) == ("A é’", ["x"], None, LINES[0])


def test_listing_ranges(spark):
    rows = listing_urls(spark, "http://h/items?page=%d", 10, 12).collect()
    assert [tuple(r) for r in rows] == [(p, f"http://h/items?page={p}") for p in (10, 11, 12)]
    assert listing_urls(spark, "%d", 3, 2).count() == 0
    ranges = spark.createDataFrame([(1, 3), (5, 4)], "a long, b long")
    assert [r["page"] for r in expand_ranges(ranges, "a", "b", F.lit("u")).collect()] == [1, 2, 3]


def test_read_pages(spark, tmp_path):
    (tmp_path / "p1.html").write_text("<h1>a\nb</h1>")
    pages = read_pages(spark, str(tmp_path / "*.html"))
    assert pages.first()["html"] == "<h1>a\nb</h1>"
    spark.range(2).withColumn("html", F.lit("x")).write.parquet(str(tmp_path / "t"))
    assert read_pages(spark, str(tmp_path / "t")).count() == 2


def test_offsets_of_a_large_scan_are_broadcast(spark):
    assert split_bytes(spark.range(1)) == 128 * 2**20
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    assert split_bytes(spark.range(1)) == 16 * 2**20
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert expected_splits(50_000, 100 * 2**40, 128 * 2**20) == 869_200 <= MAX_BROADCAST_CHUNKS
