"""Queries over scalar cleaning, dynamic JSON, numbering and file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import dynamic as D
from vitrine.functions import text as X
from vitrine.operators.keyed import keep_first, keep_last, upsert
from vitrine.operators.numbering import with_batch_no, with_line_no
from vitrine.operators.partitioning import spread_small
from vitrine.operators.validate import count_by, write_judged
from vitrine.plans.flows import check_lines
from vitrine.plans.registry import query, table
from vitrine.session import scratch_path, stage
from vitrine.sinks.files import land_pages, read_csv, write_csv, write_records, write_rejects
from vitrine.sources.pages import expand_ranges
from vitrine.sources.records import classify_lines, read_lines, read_records

_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(
    r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '\d{4}', 0), ''), text) AS year "
    "FROM documents"
)
def year_extract(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", X.year_or_self(F.col("text")).alias("year"))


@query(
    "SELECT conv_id, turn, regexp_replace(chr(160) || chr(9) || text || ' ' || chr(10), "
    f"'^{_SPACE}+|{_SPACE}+$', '', 'g') AS stripped FROM conversations"
)
def strip_text(spark, sf):
    padded = F.concat(F.lit("\u00a0\t"), "text", F.lit(" \n"))
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.strip(padded).alias("stripped")
    )


@query(
    "SELECT p_partkey, 'LE ' || p_size AS edition, 'LE ' || p_name AS edition_name FROM part"
)
def abbreviate(spark, sf):
    spaced = F.concat(F.lit("Limited Edition  "), F.col("p_size").cast("string"))
    joined = F.concat(F.lit("Limited Edition\u00a0"), "p_name")
    return table(spark, sf, "part").select(
        "p_partkey",
        X.abbreviate(spaced).alias("edition"),
        X.abbreviate(joined).alias("edition_name"),
    )


@query(
    r"SELECT doc_id, regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g') AS ascii "
    "FROM documents"
)
def ascii_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.ascii_id(F.col("text")).alias("ascii"))


@query("SELECT page_id, split_part(url, '/', -1) AS base FROM pages")
def url_basename(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.basename(F.col("url")).alias("base"))


@query(
    "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN '' ELSE d.text END AS description, "
    "CASE WHEN l.doc_id IS NULL THEN d.text ELSE '' END AS unlabelled "
    "FROM documents d LEFT JOIN labels l USING (doc_id)"
)
def default_text(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    described = docs.join(labels.select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    text, other = F.when(F.col("known"), F.col("text")), F.when(F.col("known").isNull(), F.col("text"))
    return described.select(
        "doc_id", X.coalesce_text(text).alias("description"), X.coalesce_text(other).alias("unlabelled")
    )


@query(
    "SELECT p_partkey, p_retailprice AS price, CAST(NULL AS DOUBLE) AS unknown FROM part"
)
def price_parse(spark, sf):
    free_text = F.concat(F.lit("$"), F.col("p_retailprice").cast("string"), F.lit(" / 3 pieces"))
    return table(spark, sf, "part").select(
        "p_partkey",
        X.price_or_null(free_text).alias("price"),
        X.price_or_null(F.concat(F.lit("Unknown: "), F.regexp_replace("p_name", r"\d", ""))).alias(
            "unknown"
        ),
    )


def _part_lines(spark, sf):
    """Every part as a JSON line with fields of all kinds."""
    record = F.struct(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("price"),
        (F.col("p_size") > 25).alias("large"),
        F.array("p_brand", "p_type").alias("tags"),
        F.struct("p_type").alias("nested"),
        F.lit(None).cast("string").alias("gone"),
    )
    return table(spark, sf, "part").select(
        "p_partkey", F.to_json(record, {"ignoreNullFields": "false"}).alias("raw")
    )


@query(
    """
    SELECT p_partkey, 'id' AS key, 'number' AS kind, CAST(NULL AS VARCHAR) AS text_value,
           CAST(p_partkey AS DOUBLE) AS number_value FROM part
    UNION ALL SELECT p_partkey, 'name', 'string', p_name, NULL FROM part
    UNION ALL SELECT p_partkey, 'price', 'number', NULL, p_retailprice FROM part
    UNION ALL SELECT p_partkey, 'large', 'boolean', CAST(p_size > 25 AS VARCHAR), NULL FROM part
    """
)
def metadata_typed(spark, sf):
    records = classify_lines(_part_lines(spark, sf))
    kept = records.select("p_partkey", F.explode(D.scalar_metadata(F.col("fields"))))
    kind = D.kind(F.col("value"))
    return kept.select(
        "p_partkey",
        "key",
        kind.alias("kind"),
        F.when(kind != "number", F.try_variant_get("value", "$", "string")).alias("text_value"),
        F.when(kind == "number", F.try_variant_get("value", "$", "double")).alias("number_value"),
    )


@query("SELECT p_partkey, 'gone,large,name,nested,price,tags' AS keys, p_name AS name FROM part")
def metadata_except(spark, sf):
    records = classify_lines(_part_lines(spark, sf))
    kept = records.withColumn("kept", D.metadata_except(F.col("fields")))
    return kept.select(
        "p_partkey",
        F.array_join(F.array_sort(F.map_keys("kept")), ",").alias("keys"),
        D.text_field(F.col("kept"), "name").alias("name"),
    )


@query(
    "SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k "
    "FROM events"
)
def json_scan(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    path = scratch_path(spark, "events-jsonl")
    write_records(events, path)
    schema = "event_id long, user_id long, event_type string, value double, props string"
    scanned = read_records(spark, path, schema)
    return scanned.select(
        "event_id", "user_id", "event_type", "value", F.from_json("props", "k long")["k"].alias("k")
    )


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def json_write(spark, sf):
    part = table(spark, sf, "part")
    path = scratch_path(spark, "part-jsonl")
    write_records(part, path, ascii=True)
    return read_records(spark, path, part.schema.simpleString()[7:-1].replace(":", " ")).drop("raw")


@query("SELECT doc_id, text, lang, source, n_chars, '[\"' || lang || '\"]' AS tags FROM documents")
def csv_write(spark, sf):
    docs = table(spark, sf, "documents").withColumn("tags", F.array("lang"))
    path = scratch_path(spark, "documents-csv")
    write_csv(docs, path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, tags string"
    return read_csv(spark, path, schema)


def _damaged_events(spark, sf):
    """Event properties, damaged in one way per event type."""
    raw = (
        F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)"))
        .when(F.col("event_type") == "signup", F.concat(F.lit("["), "props", F.lit("]")))
        .when(F.col("event_type") == "view", F.concat("props", F.lit(" trailing")))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", raw.alias("raw"))


@query(
    """
    WITH r AS (
      SELECT event_id, CASE event_type
          WHEN 'error' THEN substr(props, 1, length(props) - 1)
          WHEN 'signup' THEN '[' || props || ']'
          WHEN 'view' THEN props || ' trailing'
          ELSE props END AS raw
      FROM events)
    SELECT event_id,
           CASE WHEN NOT json_valid(raw) THEN 'invalid_json'
                WHEN json_type(raw) <> 'OBJECT' THEN 'not_an_object' END AS reason,
           CASE WHEN json_valid(raw) AND json_type(raw) = 'OBJECT'
                THEN CAST(json_extract(raw, '$.k') AS BIGINT) END AS k
    FROM r
    """
)
def json_quarantine(spark, sf):
    classified = classify_lines(_damaged_events(spark, sf))
    k = F.try_variant_get(F.try_element_at("fields", F.lit("k")), "$", "long")
    return classified.select("event_id", "reason", k.alias("k"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS line_no FROM events")
def line_number(spark, sf):
    return with_line_no(table(spark, sf, "events").select("event_id"), "event_id")


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) AS line_no FROM events")
def line_number_files(spark, sf):
    events = table(spark, sf, "events").select("event_id", "props")
    path = scratch_path(spark, "ordered-jsonl")
    write_records(events.repartitionByRange("event_id").sortWithinPartitions("event_id"), path)
    lines = read_lines(spark, path)
    return lines.select(F.from_json("raw", "event_id long")["event_id"].alias("event_id"), "line_no")


@query(
    """
    SELECT (line_no - 1) // 128 AS batch_no, count(*) AS n, min(event_id) AS first_id
    FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS line_no FROM events)
    GROUP BY 1
    """
)
def batch_counts(spark, sf):
    numbered = with_line_no(table(spark, sf, "events").select("ts", "event_id"), "ts", "event_id")
    return (
        with_batch_no(numbered)
        .groupBy("batch_no")
        .agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))
    )


@query(
    "SELECT page_id, page, 'http://catalogue.example/items?page=' || page AS url "
    "FROM (SELECT page_id, unnest(range(page_id, page_id + length(url) + 1)) AS page FROM pages)"
)
def listing_range(spark, sf):
    ranges = table(spark, sf, "pages").select(
        "page_id", F.col("page_id").alias("start"), (F.col("page_id") + F.length("url")).alias("end")
    )
    url = F.format_string("http://catalogue.example/items?page=%d", "page")
    return expand_ranges(ranges, "start", "end", url).select("page_id", "page", "url")


@query(
    """
    SELECT user_id AS page, event_type AS item, props AS html FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1
    """
)
def land_raw_pages(spark, sf):
    landed = table(spark, sf, "events").select(
        F.col("user_id").alias("page"), F.col("event_type").alias("item"),
        F.col("props").alias("html"), "event_id",
    )
    path = scratch_path(spark, "landed")
    land_pages(landed, path, "event_id")
    return spark.read.parquet(path).select("page", "item", "html")


@query(
    """
    SELECT user_id AS page, event_type AS item, props AS html FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) = 1
    """
)
def land_twice(spark, sf):
    """Events of even ids, then those of odd ids on top."""
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("page"), F.col("event_type").alias("item"), F.col("props").alias("html"), "event_id"
    )
    path = scratch_path(spark, "landed-twice")
    for odd in (0, 1):
        land_pages(events.filter(F.col("event_id") % 2 == odd), path, "event_id")
    return spark.read.parquet(path).select("page", "item", "html")


def document_lines(spark, sf):
    """Every document as a numbered catalogue line; labels and language decide what is wrong."""
    docs, labels = spread_small(table(spark, sf, "documents")), table(spark, sf, "labels")
    record = F.struct(
        F.when(F.col("lang") != "de", F.concat_ws("-", "source", F.col("doc_id"))).alias("name"),
        F.when(F.col("lang") == "fr", "")
        .otherwise(F.concat(F.lit("http://host.example/"), F.col("doc_id"), F.lit(".jpg")))
        .alias("image_url"),
        F.col("text").alias("description"),
        F.col("n_chars"),
    )
    line = F.to_json(record, {"ignoreNullFields": "false"})
    raw = (
        F.when(F.col("toxic") == 1, F.expr("substr(line, 1, length(line) - 1)"))
        .when(F.col("quality") == 0, F.concat(F.lit("["), "line", F.lit("]")))
        .otherwise(F.col("line"))
    )
    return (
        docs.join(labels, "doc_id", "left")
        .withColumn("line", line)
        .select("doc_id", (F.col("doc_id") + 1).alias("line_no"), raw.alias("raw"))
    )


REASON_SQL = """
    SELECT d.doc_id, d.text, d.source, d.n_chars,
           CASE WHEN l.toxic = 1 THEN 'invalid_json'
                WHEN l.quality = 0 THEN 'not_an_object'
                WHEN d.lang = 'de' THEN 'missing_id'
                WHEN d.lang = 'fr' THEN 'missing_image_url' END AS reason
    FROM documents d LEFT JOIN labels l USING (doc_id)
"""


@query(f"SELECT doc_id, coalesce(reason, 'ok') AS reason FROM ({REASON_SQL})")
def validate_reason(spark, sf):
    checked = check_lines(document_lines(spark, sf))
    return checked.select("doc_id", F.coalesce("reason", F.lit("ok")).alias("reason"))


@query(
    f"SELECT reason, count(*) AS n, min(doc_id) AS first_id FROM ({REASON_SQL}) "
    "WHERE reason IS NOT NULL GROUP BY reason"
)
def reject_tally(spark, sf):
    checked = stage(check_lines(document_lines(spark, sf)), "checked")
    rejects = checked.filter("reason IS NOT NULL")
    path = scratch_path(spark, "rejects")
    write_rejects(rejects.select("doc_id", "line_no", "raw", "reason"), path)
    written = spark.read.schema("doc_id long, line_no long, raw string, reason string").json(path)
    return written.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")
    )


@query(
    "SELECT CASE WHEN reason IS NULL THEN 'indexed' ELSE 'rejected' END AS status, count(*) AS n "
    f"FROM ({REASON_SQL}) GROUP BY 1"
)
def run_counts(spark, sf):
    checked = check_lines(document_lines(spark, sf))
    outcome = F.when(F.col("reason").isNull(), "indexed").otherwise("rejected")
    return count_by(checked, outcome)


@query(f"SELECT coalesce(reason, 'good') AS status, count(*) AS n FROM ({REASON_SQL}) GROUP BY 1")
def run_counts_written(spark, sf):
    """Counts observed by the one job that writes good rows and rejects."""
    counts = write_judged(check_lines(document_lines(spark, sf)), scratch_path(spark, "judged"))
    return spark.createDataFrame(sorted(counts.items()), "status string, n long").filter("n > 0")


@query(
    """
    WITH base AS (SELECT * FROM events WHERE event_type <> 'purchase'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
    updates AS (SELECT * FROM events WHERE event_type = 'purchase'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
    SELECT user_id, event_id, event_type, value FROM updates
    UNION ALL SELECT user_id, event_id, event_type, value FROM base
        WHERE user_id NOT IN (SELECT user_id FROM updates)
    """
)
def upsert_latest(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    base = keep_last(events.filter("event_type <> 'purchase'"), "user_id", "event_id")
    updates = events.filter("event_type = 'purchase'")
    return upsert(base, updates, "user_id", "event_id")


@query(
    """
    SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
    """,
    name="keep_first",
)
def first_kept(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "ts")
    return keep_first(events, "user_id", "ts", "event_id").drop("ts")
