"""Queries over HTML extraction, assets and URL joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import html as H
from vitrine.functions.text import text_lines
from vitrine.operators.extract import extract_records, listing_counts, listing_links
from vitrine.operators.joins import asset_manifest as manifest
from vitrine.operators.joins import failed_copies, rewrite_urls
from vitrine.operators.partitioning import spread_small
from vitrine.operators.validate import count_by
from vitrine.plans.flows import records_from_pages
from vitrine.plans.registry import query, table
from vitrine.session import scratch_path
from vitrine.sinks.files import land_pages, write_rejects
from vitrine.sources.assets import classify_assets, read_assets
from vitrine.sources.pages import read_pages


def _markup(spark, sf):
    return spread_small(table(spark, sf, "pages")).withColumnRenamed("html", "markup")


def _text_sql(element: str) -> str:
    """SQL for the text of an element: tags out, entities decoded, white space trimmed."""
    text = f"regexp_replace({element}, '<[^>]*>', '', 'g')"
    for entity, literal in [("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")]:
        text = f"regexp_replace({text}, '&{entity};?', '{literal}', 'g')"
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


@query(f"""SELECT page_id, {_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS h1 FROM pages""")
def page_h1(spark, sf):
    return _markup(spark, sf).select("page_id", H.first_text(F.col("markup"), "h1").alias("h1"))


@query(
    """SELECT page_id, nullif(regexp_extract(html, '<a href="[^"]*/th[^"]*">(.*?)</a>', 1), '') AS anchor
    FROM pages"""
)
def page_anchor_text(spark, sf):
    anchor = H.first_anchor_text(F.col("markup"), "/th")
    return _markup(spark, sf).select("page_id", anchor.alias("anchor"))


@query(
    f"""SELECT page_id,
        {_text_sql("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS advert FROM pages"""
)
def page_class_text(spark, sf):
    advert = H.first_by_classes(F.col("markup"), "div", ["ad"])
    return _markup(spark, sf).select("page_id", advert.alias("advert"))


@query(
    """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang,
        nullif(regexp_extract(html, '<a href="([^"]*)"', 1), '') AS href,
        CAST(NULL AS VARCHAR) AS image FROM pages"""
)
def page_attr(spark, sf):
    rules = {
        "lang": ("attr", "html", "lang", None),
        "href": ("attr", "a", "href", None),
        "image": ("attr", "img", "src", "img-fluid m-auto"),
    }
    found = _markup(spark, sf).select("page_id", H.fields(F.col("markup"), rules).alias("found"))
    return found.select("page_id", "found.*")


@query(
    """SELECT page_id, len(items) AS n, array_to_string(items, '|') AS texts
    FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="[^"]*">(.*?)</a></li>', 1) AS items
          FROM pages)"""
)
def page_all_texts(spark, sf):
    texts = H.all_texts(F.col("markup"), "li")
    found = _markup(spark, sf).select("page_id", texts.alias("texts"))
    return found.select(
        "page_id",
        F.size("texts").cast("long").alias("n"),
        F.array_join("texts", "|").alias("texts"),
    )


@query(
    """SELECT page_id, unnest(range(len(hrefs))) AS item, unnest(hrefs) AS href
    FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS hrefs FROM pages)"""
)
def page_links(spark, sf):
    links = listing_links(table(spark, sf, "pages"), "page_id")
    return links.withColumn("item", F.col("item").cast("long"))


@query(
    """SELECT page_id, len(regexp_extract_all(html, '<li><a href="([^"]+)"', 1))::BIGINT AS n_links
    FROM pages"""
)
def page_link_counts(spark, sf):
    path = [("nav", None), ("ul", None), ("li", None)]
    return listing_counts(table(spark, sf, "pages"), "page_id", path)


@query(
    """SELECT page_id, unnest(range(len(hrefs))) AS item,
        unnest(list_transform(hrefs, lambda h: CASE WHEN h LIKE 'http%' THEN h
            WHEN h LIKE '/%' THEN 'https://shop.example' || h ELSE 'https://shop.example/list/' || h END)) AS href
    FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS hrefs FROM pages)"""
)
def page_links_resolved(spark, sf):
    links = listing_links(table(spark, sf, "pages"), "page_id", base="https://shop.example/list/")
    return links.withColumn("item", F.col("item").cast("long"))


_ARTICLE = "regexp_extract(html, '(?s)<article>(.*?)</article>', 1)"
_H1 = "regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"


@query(
    rf"""SELECT page_id, CASE WHEN {_H1} LIKE '%the%' THEN
        regexp_replace(replace({_text_sql(_ARTICLE)}, 'the', ''), '^\s+|\s+$', '', 'g') END AS block
    FROM pages"""
)
def page_block(spark, sf):
    block = H.block_under_heading(F.col("markup"), ("article", None), "h1", "the")
    return _markup(spark, sf).select("page_id", block.alias("block"))


def catalogue_pages(spark, sf):
    """A detail page for every part, in the shape the extraction rules expect.

    Promotional parts have no table, large ones an empty edition cell, and a commented-out
    heading precedes the real one. The badge holds an element of its own name, the table a
    table, and references outside the old set occur.
    """
    cells = F.concat(
        F.lit('<table class="table table-bordered"><tr><td>Edition</td><td>'),
        F.when(F.col("p_type") == "LARGE", "").otherwise(
            F.concat(F.lit("Limited Edition  "), F.col("p_size"))
        ),
        F.lit("</td></tr><tr><td>Release Date</td><td>May 5, 2003 or 2004</td></tr>\n<tr><td>"),
        F.lit("Original Price</td><td> $"),
        F.col("p_retailprice"),
        F.lit(" </td></tr><tr><td>More</td><td><table class='x'><tr><td>in</td></tr></table></td></tr><tr><td>SKU</td><td>S"),
        F.col("p_partkey"),
        F.lit("</td></tr></table>"),
    )
    page = F.concat(
        F.lit('<!-- <h1 class="h3">old</h1> --><html><body><h1>x</h1><h1 class="big h3">\n <b>'),
        "p_name",
        F.lit('</b> &amp; &#39;co&#x27; </h1><a href="/series/'),
        F.col("p_size"),
        F.lit('">Series '),
        "p_brand",
        F.lit("</a><a href='/origin/1'>Made by "),
        "p_type",
        F.lit('</a><span class="rarity badge big">'),
        F.lower("p_type"),
        F.lit(" <span>rare</span> it&#146;s &check;</span>"),
        F.when(F.col("p_type") == "PROMO", "").otherwise(cells),
        F.lit('<img class="m-auto img-fluid" src="no">'),
        F.lit('<img class="img-fluid m-auto" src=" http://host.example/'),
        F.col("p_partkey"),
        F.lit('.jpg "><a class="badge rounded-pill bg-secondary">'),
        "p_brand",
        F.lit('</a><a class="badge rounded-pill bg-secondary"> '),
        "p_type",
        F.lit(' </a><div class="card-body"><h5>Other</h5>no</div>'),
        F.lit('<div class="card-body"><h5>Pin Description:</h5><div> About '),
        "p_name",
        F.lit("</div> and more </div></body></html>"),
    )
    return table(spark, sf, "part").select("p_partkey", page.alias("html"))


_EDITION = """CASE p_type WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN 'Release Date'
    ELSE 'Limited Edition  ' || p_size END"""


@query(
    f"""SELECT p_partkey, {_EDITION} AS edition,
        CASE WHEN p_type <> 'PROMO' THEN 'May 5, 2003 or 2004' END AS release_date,
        CASE WHEN p_type <> 'PROMO' THEN '$' || p_retailprice END AS original_price,
        CASE WHEN p_type <> 'PROMO' THEN 'S' || p_partkey END AS sku,
        CAST(NULL AS VARCHAR) AS last_line FROM part"""
)
def kv_lines(spark, sf):
    lines = H.table_lines(F.col("html"), "table table-bordered")
    pages = spread_small(catalogue_pages(spark, sf)).withColumn("lines", lines)
    keys = ["Edition", "Release Date", "Original Price", "SKU"]
    values = [
        H.value_after(F.col("lines"), key).alias(key.lower().replace(" ", "_")) for key in keys
    ]
    last = H.value_after(F.col("lines"), F.concat(F.lit("S"), F.col("p_partkey")))
    return pages.select("p_partkey", *values, last.alias("last_line"))


@query(
    """SELECT doc_id, l.n AS line_pos, l.line AS key, l.next AS value FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(lines) + 1),
            lambda i: {'n': i, 'line': lines[i], 'next': lines[i + 1]})) AS l
        FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
                  lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS lines
              FROM documents)) WHERE l.next IS NOT NULL"""
)
def line_pairs(spark, sf):
    docs = spread_small(table(spark, sf, "documents")).withColumn("lines", text_lines(F.col("text")))
    pairs = docs.select("doc_id", F.posexplode(H.line_pairs(F.col("lines"))).alias("pos", "pair"))
    return pairs.select(
        "doc_id",
        (F.col("pos") + 1).cast("long").alias("line_pos"),
        F.col("pair.key").alias("key"),
        F.col("pair.value").alias("value"),
    )


@query(
    f"""SELECT p_partkey, p_name || ' & ''co''' AS name, 'Series ' || p_brand AS series,
        lower(p_type) || ' rare it’s ✓' AS rarity, 'Made by ' || p_type AS origin, {_EDITION} AS edition,
        CASE WHEN p_type <> 'PROMO' THEN 'May 5, 2003 or 2004' END AS release_date,
        CASE WHEN p_type <> 'PROMO' THEN '$' || p_retailprice END AS original_price,
        CASE WHEN p_type <> 'PROMO' THEN 'S' || p_partkey END AS sku,
        'About ' || p_name || ' and more' AS description,
        'http://host.example/' || p_partkey || '.jpg' AS image_url,
        p_brand || '|' || p_type AS tags FROM part""",
    name="extract_records",
)
def extracted_records(spark, sf):
    records = extract_records(catalogue_pages(spark, sf), keep=("p_partkey",))
    return records.withColumn("tags", F.array_join("tags", "|"))


@query(
    """SELECT p_partkey, p_name || ' & ''co''' AS name,
        CASE p_type WHEN 'PROMO' THEN NULL WHEN 'LARGE' THEN 'Release Date'
            ELSE 'LE ' || p_size END AS edition,
        CASE WHEN p_type <> 'PROMO' THEN '2003' END AS release_date FROM part"""
)
def cleaned_records(spark, sf):
    records = records_from_pages(catalogue_pages(spark, sf), keep=("p_partkey",))
    return records.select("p_partkey", "name", "edition", "release_date")


@query(
    """
    WITH urls AS (SELECT url, max(page_id) AS last FROM pages WHERE url <> '' GROUP BY url)
    SELECT 'images/' || split_part(url, '/', -1) AS dest, max_by(url, last) AS src_url,
           count(*) AS n_sources, count(*) > 1 AS collides
    FROM urls GROUP BY 1
    """
)
def asset_manifest(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("image_url"))
    return manifest(pages, "images/", "page_id")


@query(
    """SELECT page_id, CASE WHEN url LIKE 'https%'
        THEN 'https://store.example/images/' || split_part(url, '/', -1) ELSE url END AS image_url
    FROM pages"""
)
def url_rewrite(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("image_url"))
    return rewrite_urls(pages, _copies(pages))


def _copies(pages):
    """Copies of which those of unencrypted addresses failed."""
    return pages.select(
        F.col("image_url").alias("src_url"),
        F.col("image_url").startswith("https").alias("ok"),
        F.concat(
            F.lit("https://store.example/images/"), F.substring_index("image_url", "/", -1)
        ).alias("new_url"),
    )


@query(
    """SELECT page_id + 1 AS line_no, reason, count(*) OVER (PARTITION BY reason) AS n
    FROM (SELECT page_id, 'asset_unavailable' AS reason FROM pages WHERE url NOT LIKE 'https%')"""
)
def copy_rejects(spark, sf):
    """Records whose copy failed, as written to the reject sink."""
    pages = table(spark, sf, "pages").select(
        (F.col("page_id") + 1).alias("line_no"), F.col("url").alias("image_url")
    )
    failed = failed_copies(pages, _copies(pages)).withColumn("raw", F.col("image_url"))
    path = scratch_path(spark, "copy-rejects")
    write_rejects(failed.select("line_no", "raw", "reason"), path)
    written = spark.read.schema("line_no long, raw string, reason string").json(path)
    tally = count_by(written, F.col("reason")).withColumnRenamed("status", "reason")
    return written.join(tally, "reason").select("line_no", "reason", "n")


@query("SELECT page_id, url, html FROM pages")
def landed_pages(spark, sf):
    path = scratch_path(spark, "landed-pages")
    pages = table(spark, sf, "pages").withColumnRenamed("page_id", "page")
    land_pages(pages.withColumn("item", F.lit(0)), path, "page")
    return read_pages(spark, path).select(F.col("page").alias("page_id"), "url", "html")


@query(
    """SELECT item_id, octet_length(encode(text)) + 5 AS length, 'gif' AS format, true AS ok,
        sha256('GIF8' || text || chr(10)) AS body FROM benchmark"""
)
def asset_files(spark, sf):
    """Every benchmark text as a file of its own behind the first bytes of an image."""
    folder = scratch_path(spark, "assets")
    items = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("GIF8"), "text").alias("value"))
    items.repartition("item_id").write.partitionBy("item_id").text(folder)
    return read_assets(spark, folder, "*.txt").select(
        F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"),
        "length",
        "format",
        "ok",
        F.sha2("content", 256).alias("body"),
    )


@query(
    r"""
    WITH a AS (SELECT doc_id, CASE lang WHEN 'en' THEN '\xFF\xD8\xFF\xE0'::BLOB || encode(text)
               WHEN 'de' THEN '\x89PNG\x0D\x0A\x1A\x0A'::BLOB || encode(text)
               WHEN 'fr' THEN encode(text) END AS content, lang FROM documents)
    SELECT doc_id, octet_length(content) AS length,
           CASE lang WHEN 'en' THEN 'jpeg' WHEN 'de' THEN 'png' END AS format,
           lang IN ('en', 'de') AS ok
    FROM a
    """
)
def asset_scan(spark, sf):
    body = F.encode("text", "UTF-8")
    content = (
        F.when(F.col("lang") == "en", F.concat(F.unhex(F.lit("FFD8FFE0")), body))
        .when(F.col("lang") == "de", F.concat(F.unhex(F.lit("89504E470D0A1A0A")), body))
        .when(F.col("lang") == "fr", body)
    )
    assets = classify_assets(table(spark, sf, "documents").withColumn("content", content))
    return assets.select("doc_id", "length", "format", "ok")
