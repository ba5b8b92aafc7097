import json

from pyspark.sql import functions as F

from vitrine.sinks.files import land_pages, read_csv, write_csv, write_records, write_rejects
from vitrine.sources.assets import read_assets
from vitrine.sources.records import RECORD_SCHEMA, read_records


def lines(path):
    return [line for f in sorted(path.glob("part-*")) for line in f.read_text("utf-8").splitlines()]


def record(spark, name="Children’s ☃ 𝄞"):
    schema = RECORD_SCHEMA
    return spark.createDataFrame([(name, None, None, None, None, None, None, None, "a\nb", None, [])], schema)


def test_nulls_are_written_and_ascii_is_escaped(spark, tmp_path):
    write_records(record(spark), str(tmp_path / "u"))
    write_records(record(spark), str(tmp_path / "a"), ascii=True)
    (plain,), (escaped,) = lines(tmp_path / "u"), lines(tmp_path / "a")
    assert "’" in plain and escaped.isascii()
    for line in (plain, escaped):
        data = json.loads(line)
        assert data["name"] == "Children’s ☃ 𝄞" and data["series"] is None and data["tags"] == []
        assert len(data) == 11


def test_round_trip_and_append(spark, tmp_path):
    path = str(tmp_path / "r")
    write_records(record(spark), path)
    write_records(record(spark, "two"), path)
    assert read_records(spark, path).count() == 2
    write_records(record(spark, "three"), path, mode="overwrite")
    back = read_records(spark, path).drop("raw")
    assert back.collect() == record(spark, "three").collect()


def test_csv(spark, tmp_path):
    rows = [(1, 'say "hi", a\nb', ["x", "y"]), (2, None, [])]
    df = spark.createDataFrame(rows, "id int, text string, tags array<string>").coalesce(1)
    write_csv(df, str(tmp_path / "c"))
    assert lines(tmp_path / "c")[0] == "id,text,tags"
    back = read_csv(spark, str(tmp_path / "c"), "id int, text string, tags string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'say "hi", a\nb', '["x","y"]'), (2, None, "[]")]


def test_landing_keeps_the_last_page(spark, tmp_path):
    rows = [(1, 0, "old", 1), (1, 0, "new", 2), (1, 1, "x", 1), (2500, 0, "y", 1)]
    df = spark.createDataFrame(rows, "page int, item int, html string, n int")
    land_pages(df, str(tmp_path / "p"), "n")
    back = spark.read.parquet(str(tmp_path / "p"))
    assert sorted((r["page"], r["item"], r["html"]) for r in back.collect()) == [(1, 0, "new"), (1, 1, "x"), (2500, 0, "y")]
    assert {p.name for p in (tmp_path / "p").glob("page_range=*")} == {"page_range=0", "page_range=2"}


def test_landing_adds_to_what_is_there(spark, tmp_path):
    path, schema = str(tmp_path / "p"), "page int, item int, html string, n int"
    land_pages(spark.createDataFrame([(1, 0, "a", 9), (2, 0, "b", 1), (2500, 0, "far", 1), (None, 0, "no page", 1)], schema), path, "n")
    files = {f.name for f in (tmp_path / "p" / "page_range=2").iterdir()}
    land_pages(spark.createDataFrame([(1, 0, "again", 1), (1, 1, "other item", 1), (5000, 0, "c", 1)], schema), path, "n")
    land_pages(spark.createDataFrame([(None, 0, "no page again", 1)], schema).withColumn("extra", F.lit("x")), path, "n")
    land_pages(spark.createDataFrame([], schema), path, "n")
    back = spark.read.option("mergeSchema", True).parquet(path).collect()
    assert sorted(((r["page"], r["item"], r["html"], r["extra"]) for r in back), key=str) == sorted(
        [(1, 0, "again", None), (1, 1, "other item", None), (2, 0, "b", None), (2500, 0, "far", None), (5000, 0, "c", None),
         (None, 0, "no page again", "x")], key=str)
    assert {f.name for f in (tmp_path / "p" / "page_range=2").iterdir()} == files


def test_rejects(spark, tmp_path):
    df = spark.range(3).withColumn("reason", F.lit("missing_id"))
    for mode, expected in (("overwrite", 3), ("append", 6), ("overwrite", 3)):
        write_rejects(df, str(tmp_path / "x"), mode)
        assert len(lines(tmp_path / "x")) == expected


def test_assets(spark, tmp_path):
    files = {
        "a.jpg": b"\xff\xd8\xff\xe0rest", "b.png": b"\x89PNG\r\n\x1a\n", "c.gif": b"GIF89a", "d.bmp": b"BMxx",
        "e.webp": b"RIFF\x00\x00\x00\x00WEBPVP8 ", "f.txt": b"hello", "g.jpg": b"", "h.wav": b"RIFF\x00\x00\x00\x00WAVE",
        "i.tif": b"II*\x00xx",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_assets(spark, str(tmp_path)).collect()}
    formats = {name: r["format"] for name, r in rows.items()}
    assert formats == {"a.jpg": "jpeg", "b.png": "png", "c.gif": "gif", "d.bmp": "bmp", "e.webp": "webp",
                       "f.txt": None, "h.wav": None, "i.tif": "tiff"}  # Spark lists no empty files
    assert all(r["length"] == len(files[n]) and bytes(r["content"]) == files[n] for n, r in rows.items())
    assert read_assets(spark, str(tmp_path), "*.jpg").count() == 1
