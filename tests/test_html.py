import html

from pyspark.sql import functions as F

from vitrine.functions import html as H
from vitrine.operators.extract import LISTING_PATH, extract_records, listing_counts, listing_links

DETAIL = """<h1 class="h3"> Title </h1>
<a href="/series/9">Series X</a><a href="/origin/2">Origin Y</a>
<span class="rarity badge big">epic</span>
<table class="table table-bordered">
  <tr><td>Edition</td><td>Limited Edition  418</td></tr>
  <tr><td>Release Date</td><td>2003-10-17</td></tr>
  <tr><td>Original Price</td><td>$8.50</td></tr>
  <tr><td>SKU</td><td>S1</td></tr></table>
<img class="img-fluid m-auto" src=" http://h/p/1.jpg ">
<a class="badge rounded-pill bg-secondary">t1</a><a class="badge rounded-pill bg-secondary"> t2 </a>
<div class="card-body"><h5>Other</h5>no</div>
<div class="card-body"><h5>Pin Description:</h5> Text &amp; more </div>
"""
EXPECTED = ("Title", "Series X", "epic", "Origin Y", "Limited Edition  418", "2003-10-17", "$8.50",
            "S1", "Text & more", "http://h/p/1.jpg", ["t1", "t2"])
NAMES = ("name", "series", "rarity", "origin", "edition", "release_date", "original_price", "sku",
         "description", "image_url", "tags")


def records(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "n int, html string").coalesce(1)
    rows = extract_records(df, keep=("n",)).orderBy("n").collect()
    return [{name: row[name] for name in NAMES} for row in rows]


def test_detail_page(spark):
    assert records(spark, DETAIL) == [dict(zip(NAMES, EXPECTED))]


def test_page_variants(spark):
    no_table = DETAIL[: DETAIL.index("<table")] + DETAIL[DETAIL.index("<img"):]
    variants = [
        DETAIL,
        no_table,
        DETAIL.replace("Limited Edition  418", ""),
        DETAIL.replace("<td>S1</td></tr>", "<td>S1</td></tr><tr><td>SKU</td><td>S2</td></tr>"),
        DETAIL.replace("<td>S1</td>", "<td></td>"),
        DETAIL.replace("img-fluid m-auto", "m-auto img-fluid"),
        DETAIL.replace("badge rounded-pill bg-secondary", "other"),
        "",
        None,
    ]
    rows = records(spark, *variants)
    table = ("edition", "release_date", "original_price", "sku")
    assert [rows[1][k] for k in table] == [None] * 4
    assert rows[2]["edition"] == "Release Date"
    assert rows[3]["sku"] == "S2"
    assert rows[4]["sku"] is None
    assert rows[5]["image_url"] is None
    assert rows[6]["tags"] == []
    assert rows[7] == dict(dict.fromkeys(NAMES), tags=[])
    assert rows[8]["name"] is None


def test_first_text_null_and_empty(values):
    pages = ["<h1>a</h1>", "<h1 class='h3'></h1>", '<!--<h1 class="h3">no</h1>--><h1 class="x h3">b<i>c</i></h1>']
    found = H.first_text(F.col("v"), "h1", "h3")
    assert values(found, pages) == [None, "", "bc"]


def test_script_bodies_are_not_markup(values):
    page = '<script>var t="<h1>no</h1>";</script><h1>yes</h1>'
    assert values(H.first_text(F.col("v"), "h1"), [page]) == ["yes"]


def test_nested_same_tag_is_reached(values):
    page = '<span class="x"><span class="rarity badge">epic</span></span>'
    assert values(H.first_by_classes(F.col("v"), "span", ["badge", "rarity"]), [page]) == ["epic"]


def test_all_descendant_text(values):
    pages = [
        '<span class="badge rarity">epic <span>rare</span> tail</span>',
        '<span class="badge rarity">a<b>b<span>c</span></b>d<br>e<img src="x">f</span>no',
        '<span class="badge rarity">it&#146;s &check; &lbrace; &#150; x</span>',
        '<span class="badge rarity">open <i>to the end',
        '<div><span class="badge rarity">ends with</div> its container',
        '<span class="badge rarity">a</b></i>b</span>c',
    ]
    found = ["epic rare tail", "abcdef", "it\u2019s \u2713 { \u2013 x", "open to the end", "ends with", "ab"]
    assert values(H.first_by_classes(F.col("v"), "span", ["badge", "rarity"]), pages) == found
    table = '<table class="t"><tr><td>k<td><table><tr><td>in</table><tr><td>SKU</td><td>S1</td></tr></table>'
    assert values(H.table_lines(F.col("v"), "t"), [table]) == [["k", "in", "SKU", "S1"]]
    nested = '<ul><li class="x">a<ul><li class="x">b</li></ul></li></ul>'
    assert values(H.all_texts(F.col("v"), "li", "x"), [nested]) == [["ab", "b"]]


def test_character_references():
    texts = ["a &amp;lt; b", "&#39;&#x27;&quot;", "caf&eacute; &copy;", "&bogus; & &#xD800;", "plain", "&nbsp;",
             "&ampThe &amp &AMP; &notit; &copy=1 &#39a &#x41", "&check;&lbrace;&#146;&#150;"]
    assert [H.decode_text(t) for t in texts] == [html.unescape(t) for t in texts]
    assert H.decode_value("?a=1&copy=2&amp;b&lt&gt;&#65") == "?a=1&copy=2&b<>A"


def test_attribute_quoting(values):
    tags = ["<a href='x>y'>", "<a HREF=plain>", '<a data-href="no">', '<a title=">" href = "z">',
            '<a href="?a=1&copy=2&amp;b">', "<a href>", "<a href=''>"]
    found = ["x>y", "plain", None, "z", "?a=1&copy=2&b", "", ""]
    assert values(H.first_attr(F.col("v"), "a", "href"), tags) == found


def test_fields_share_one_parse(spark):
    rules = {"a": ("text", "h1", None), "b": ("links", [("li", None)], None), "c": ("links", [], "http://h/x/")}
    page = '<h1>t</h1><li><a href="u">1</a></li><a href="/v">2</a>'
    df = spark.createDataFrame([(page,), (None,), ("",)], "v string")
    found = df.select(H.fields(F.col("v"), rules).alias("f")).select("f.*")
    assert [tuple(r) for r in found.collect()] == [
        ("t", ["u"], ["http://h/x/u", "http://h/v"]), (None, None, None), (None, [], [])
    ]
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_value_after(values):
    lines = [["k", "1", "k", "2"], ["k"], [], None, ["a", "k"]]
    assert values(H.value_after(F.col("v"), "k"), lines, "v array<string>") == ["2", None, None, None, None]


def test_block_nesting(values):
    pages = [
        '<div class="card-body"><div>in</div><h5><b>Pin</b> Description:</h5>out</div>tail',
        '<div class="card-body"><h5>Other</h5><h5>Pin Description:</h5></div>',
        '<div class="outer card-body">o<div class="card-body"><h5>Pin Description:</h5>i</div></div>',
        '<div class="card-body"><h5>Pin Description:</h5>x<script>no</script>Pin Description:',
        None,
    ]
    found = H.block_under_heading(F.col("v"), ("div", "card-body"), "h5", "Pin Description:")
    assert values(found, pages) == ["inout", None, "oi", "x", None]


def test_listing(spark, values):
    card = '<div class="pin-card"><img><div class="card-body"><h5 class="card-title">{}</h5></div></div>'
    page = card.format('<a href="/p/1">one</a>') + card.format("<a>none</a>") + '<a href="/other">x</a>'
    assert values(H.hrefs_below(F.col("v"), LISTING_PATH), [page]) == [["/p/1"]]
    df = spark.createDataFrame([(7, page)], "page int, html string")
    assert [tuple(r) for r in listing_links(df, "page", LISTING_PATH).collect()] == [(7, 0, "/p/1")]
    assert listing_links(df, "page").count() == 2
    assert values(H.hrefs_below(F.col("v"), [("h5", "card-title")]), [page]) == [["/p/1"]]
    both = spark.createDataFrame([(7, page), (8, "<p>none</p>"), (9, None)], "page int, html string")
    assert {r.page: r.n_links for r in listing_counts(both, "page", LISTING_PATH).collect()} == {7: 1, 8: 0, 9: 0}
    resolved = listing_links(df, "page", LISTING_PATH, "https://h.example/list?page=2")
    assert [r.href for r in resolved.collect()] == ["https://h.example/p/1"]


def test_broken_pages_take_linear_time(spark):
    pages = [
        "<!-- " * 20000,
        '<a href="/series/1">' * 20000,
        '<a title="' + '<b class="x">t</b>' * 5000,
        '<h1 class="h3">a' + " " * 200000 + "x</h1>",
        "<script>" * 20000,
        "<" * 100000,
    ]
    rows = records(spark, *pages)
    assert [r["name"] for r in rows] == [None, None, None, "a" + " " * 200000 + "x", None, None]
    assert rows[1]["series"] == ""


def test_text_that_looks_like_a_tag(values):
    pages = ["<h1>a < b > c</h1>", "<h1 title='x > y'>t<!DOCTYPE z></h1>", "<h1 title=don't>u</h1>", "<h1>open <p>end"]
    assert values(H.first_text(F.col("v"), "h1"), pages) == ["a < b > c", "t", "u", "open end"]
