"""Queries over vector arithmetic, search, near-duplicates, the index and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import vectors as V
from vitrine.functions.dynamic import text_field
from vitrine.functions.minhash import band_keys, band_layout
from vitrine.operators.joins import attach_embedding
from vitrine.operators.neardup import drop_near_dups, signature_buckets
from vitrine.operators import ivf
from vitrine.operators import topk as K
from vitrine.operators.vectors import BATCH_SIZE, embed, embed_distinct, fan_out, vec_mean
from vitrine.plans.flows import (
    full_entries,
    indexed_per_batch,
    search_index,
    search_values,
    simple_entries,
)
from vitrine.plans.registry import fixed_point, query, table
from vitrine.plans.text_queries import REASON_SQL, document_lines
from vitrine.session import scratch_path, stage
from vitrine.sinks.files import write_records
from vitrine.sources.index_store import ensure_index, open_index
from vitrine.streaming.ingest import run_available, stream_records
from vitrine.streaming.upsert import stream_drop_near_dups, stream_upsert

DIM = 64
# With 64 dimensions the signature must use far fewer than all of them.
TOP_M = 8
COPY_OFFSET = 100_000
_REVERSED = "list_reverse(v)"
_SQL_BASE = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
# Mean vector of one label, the query vector of the single-query searches.
_SQL_QUERY = """q AS (SELECT list(x ORDER BY pos) AS q FROM (
    SELECT pos, avg(x) AS x FROM (
        SELECT unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e WHERE label = 3)
    GROUP BY pos))"""


def _fixed(list_sql: str) -> str:
    """SQL counterpart of ``fixed_point``."""
    return (
        f"array_to_string(list_transform({list_sql}, "
        "lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',')"
    )


def _embeddings(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings")


def _label_mean(spark, sf) -> list[float]:
    """Mean vector of label 3: one row of fixed length."""
    label = _embeddings(spark, sf).filter("label = 3")
    return vec_mean(label, "label").first()["embedding"]


@query(
    f"""WITH {_SQL_BASE}
    SELECT label, CAST(pos AS INTEGER) - 1 AS pos, round(avg(x), 6) AS x FROM (
        SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)
    GROUP BY label, pos"""
)
def vec_centroid(spark, sf):
    means = vec_mean(_embeddings(spark, sf), "label")
    rows = means.select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(
    f"""WITH {_SQL_BASE}, w AS (
        SELECT vec_id, v, {_REVERSED} AS r FROM e)
    SELECT vec_id, {_fixed("list_transform(range(1, 65), lambda i: (v[i] + r[i] + 3 * v[i] - r[i]) / 4)")}
        AS mean FROM w"""
)
def vec_mean_variants(spark, sf):
    v = F.col("embedding").cast("array<double>")
    r = F.reverse(v)
    variants = F.array(
        v, r, F.transform(v, lambda x: 3 * x), F.transform(r, lambda x: -x)
    )
    mean = V.mean_of_variants(variants)
    return _embeddings(spark, sf).select("vec_id", fixed_point(mean).alias("mean"))


@query(
    f"""WITH {_SQL_BASE}, s AS (
        SELECT vec_id, list_transform(v, lambda x: x * label) AS v FROM e)
    SELECT vec_id, CASE WHEN list_dot_product(v, v) > 0 THEN
        {_fixed("list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))")} END AS unit FROM s"""
)
def vec_normalize(spark, sf):
    scaled = F.transform("embedding", lambda x: x.cast("double") * F.col("label"))
    return _embeddings(spark, sf).select(
        "vec_id", fixed_point(V.l2_normalize(scaled)).alias("unit")
    )


@query(
    f"""WITH {_SQL_BASE}, w AS (SELECT vec_id, v, {_REVERSED} AS r FROM e)
    SELECT vec_id, {_fixed("list_transform(range(1, 65), lambda i: v[i] * 0.7::DOUBLE + r[i] * 0.3::DOUBLE)")}
        AS mixed FROM w"""
)
def vec_hybrid(spark, sf):
    mixed = V.hybrid(F.col("embedding"), F.reverse("embedding"))
    return _embeddings(spark, sf).select("vec_id", fixed_point(mixed).alias("mixed"))


_TOP_DIMS = (
    "list_transform(list_slice(list_reverse_sort(list_transform(range(1, 65), "
    "lambda i: {'x': v[i], 'i': i - 1})), 1, 8), lambda s: s.i)"
)


@query(
    f"""WITH {_SQL_BASE} SELECT vec_id, array_to_string({_TOP_DIMS}, ',') AS dims FROM e"""
)
def top_dims(spark, sf):
    dims = F.array_join(V.top_dims(F.col("embedding"), TOP_M).cast("array<string>"), ",")
    return _embeddings(spark, sf).select("vec_id", dims.alias("dims"))


@query(
    f"""WITH {_SQL_BASE}, {_SQL_QUERY}
    SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q
    ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 10"""
)
def topk_cosine(spark, sf):
    found = K.topk(
        _embeddings(spark, sf), _label_mean(spark, sf), 10, id_col="vec_id", kernel="jvm"
    )
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_SQL_BASE}, {_SQL_QUERY}
    SELECT vec_id, round(list_distance(v, q), 6) AS score FROM e, q
    ORDER BY list_distance(v, q), vec_id LIMIT 5"""
)
def topk_euclid(spark, sf):
    found = K.topk(
        _embeddings(spark, sf), _label_mean(spark, sf), 5, "euclidean", id_col="vec_id"
    )
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_SQL_BASE}, {_SQL_QUERY}
    SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score FROM e, q
    ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 10"""
)
def topk_cosine_matrix(spark, sf):
    found = K.topk(
        _embeddings(spark, sf), _label_mean(spark, sf), 10, id_col="vec_id", kernel="arrow"
    )
    return found.withColumn("score", F.round("score", 6))


PART_FILTER = {"p_type": {"$eq": "SMALL"}, "p_retailprice": {"$lt": 950}}


def _with_part(spark, sf) -> DataFrame:
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "vec_id")
    return _embeddings(spark, sf).join(part, "vec_id", "left")


@query(
    f"""WITH {_SQL_BASE}, {_SQL_QUERY}
    SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS score, p_name, p_retailprice
    FROM e JOIN part ON p_partkey = vec_id, q
    WHERE p_type = 'SMALL' AND p_retailprice < 950
    ORDER BY list_cosine_similarity(v, q) DESC, vec_id LIMIT 5"""
)
def topk_filtered(spark, sf):
    found = K.topk(
        _with_part(spark, sf),
        _label_mean(spark, sf),
        5,
        conditions=PART_FILTER,
        id_col="vec_id",
        metadata=("p_name", "p_retailprice"),
    )
    return found.withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_SQL_BASE}, {_SQL_QUERY}
    SELECT vec_id, round(score, 6) AS score, p_name, p_brand, p_type, p_size, p_retailprice FROM (
        SELECT vec_id, list_cosine_similarity(v, q) AS score FROM e, q
        ORDER BY score DESC, vec_id LIMIT 10) JOIN part ON p_partkey = vec_id"""
)
def topk_metadata(spark, sf):
    found = K.topk(_embeddings(spark, sf), _label_mean(spark, sf), 10, id_col="vec_id")
    part = table(spark, sf, "part").withColumnRenamed("p_partkey", "vec_id")
    return K.attach_metadata(found, part, "vec_id").withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_SQL_BASE}, {_SQL_QUERY}, t AS (
        SELECT vec_id, list_cosine_similarity(v, q) AS score FROM e, q
        ORDER BY score DESC, vec_id LIMIT 10),
    r AS (SELECT row_number() OVER (ORDER BY score DESC, vec_id) AS rank, * FROM t
        JOIN documents ON doc_id = vec_id)
    SELECT CAST(rank AS INTEGER) AS rank, vec_id, printf('%.4f', score) AS score_text,
        'http://host.example/' || vec_id || '.jpg' AS image_url, m.key AS key, m.value AS value
    FROM (SELECT rank, vec_id, score, unnest([{{'key': 'lang', 'value': lang}},
            {{'key': 'source', 'value': source}}, {{'key': 'text', 'value': text}}]) AS m FROM r)
    WHERE length(m.value) < 100"""
)
def topk_present(spark, sf):
    found = K.topk(_embeddings(spark, sf), _label_mean(spark, sf), 10, id_col="vec_id")
    docs = table(spark, sf, "documents").withColumnRenamed("doc_id", "vec_id")
    url = F.concat(F.lit("http://host.example/"), F.col("vec_id"), F.lit(".jpg"))
    pairs = [F.lit("image_url"), url]
    for name in ("lang", "source", "text"):
        pairs += [F.lit(name), F.col(name)]
    wide = docs.select("vec_id", F.create_map(*pairs).alias("metadata"))
    shown = K.present(K.attach_metadata(found, wide, "vec_id"), id_col="vec_id")
    return shown.select("rank", "vec_id", "score_text", "image_url", F.explode("shown"))


def _batch_sql(score: str, direction: str) -> str:
    return f"""WITH {_SQL_BASE}, c AS (
        SELECT label, list(x ORDER BY pos) AS q FROM (
            SELECT label, pos, avg(x) AS x FROM (
                SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e)
            GROUP BY label, pos) GROUP BY label),
    s AS (SELECT c.label AS query_id, vec_id AS id, {score} AS score FROM c, e)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, id) AS rank
        FROM s) WHERE rank <= 5"""


def _label_queries(spark, sf) -> DataFrame:
    means = vec_mean(_embeddings(spark, sf), "label")
    return means.select(F.col("label").alias("query_id"), F.col("embedding").alias("query"))


@query(_batch_sql("list_cosine_similarity(v, q)", "DESC"))
def topk_batch(spark, sf):
    found = K.topk_batch(_embeddings(spark, sf), _label_queries(spark, sf), 5, id_col="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query(_batch_sql("list_distance(v, q)", ""))
def topk_batch_euclid(spark, sf):
    found = K.topk_batch(
        _embeddings(spark, sf), _label_queries(spark, sf), 5, "euclidean", id_col="vec_id"
    )
    return found.withColumn("score", F.round("score", 6))


def _moved_sql(moved: str, scale: str) -> str:
    """The batch search over vectors whose elements are ``moved``, scores times ``scale``."""
    base = f"e AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: {moved}) AS v FROM embeddings)"
    return _batch_sql("list_distance(v, q)", "").replace(_SQL_BASE, base).replace("round(score, 6)", f"round(score * {scale}, 4)")


def _moved_batch(spark, sf, moved, scale: float) -> DataFrame:
    rows = _embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: moved(x.cast("double"))))
    means = vec_mean(rows, "label").select(F.col("label").alias("query_id"), F.col("embedding").alias("query"))
    found = K.topk_batch(rows, means, 5, "euclidean", id_col="vec_id")
    return found.withColumn("score", F.round(F.col("score") * scale, 4))


@query(_moved_sql("x * 1e-7::DOUBLE", "1e7::DOUBLE"))
def topk_batch_euclid_small(spark, sf):
    return _moved_batch(spark, sf, lambda x: x * 1e-7, 1e7)


@query(_moved_sql("x + 1e6::DOUBLE", "1::DOUBLE"))
def topk_batch_euclid_offset(spark, sf):
    return _moved_batch(spark, sf, lambda x: x + 1e6, 1.0)


def _hundredths(spark, sf) -> DataFrame:
    return _embeddings(spark, sf).filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query(
    f"""WITH {_SQL_BASE}, s AS (
        SELECT a.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(e.v, a.v) AS score FROM e a, e WHERE a.vec_id % 100 = 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5"""
)
def topk_pivots(spark, sf):
    """Every hundredth vector against all of them, by pivots and bounds."""
    found = K.topk_batch(_embeddings(spark, sf), _hundredths(spark, sf), 5, id_col="vec_id", by_cells=True)
    return found.withColumn("score", F.round("score", 6))


@query("SELECT count(*) AS n_queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, sf):
    """Whether an inverted file finds at least 0.9 of the exact ten of every hundredth vector."""
    index, asked = _embeddings(spark, sf), _hundredths(spark, sf)
    file = ivf.build(index, scratch_path(spark, "ivf"), id_col="vec_id")
    found = ivf.search_batch(file, asked, 10).select("query_id", "id", F.lit(1.0).alias("hit"))
    exact = K.topk_batch(index, asked, 10, id_col="vec_id").join(found, ["query_id", "id"], "left")
    return exact.agg(F.countDistinct("query_id").alias("n_queries"), (F.avg(F.coalesce("hit", F.lit(0.0))) >= 0.9).alias("enough"))


@query()
def topk_ann(spark, sf):
    found = K.topk_ann(_embeddings(spark, sf), _label_mean(spark, sf), 10, id_col="vec_id")
    return found.withColumn("score", F.round("score", 6))


@query(
    """SELECT doc_id, CASE WHEN vec_id IS NULL THEN 'embedding_failed' ELSE 'ok' END AS status,
        CAST(len(embedding) AS INTEGER) AS dim
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""
)
def embed_join(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    vectors = _embeddings(spark, sf).withColumnRenamed("vec_id", "doc_id")
    good, rejects = attach_embedding(docs, vectors, "doc_id")
    found = good.select("doc_id", F.lit("ok").alias("status"), F.size("embedding").alias("dim"))
    missing = rejects.select(
        "doc_id", F.col("reason").alias("status"), F.lit(None).cast("int").alias("dim")
    )
    return found.unionByName(missing)


def hashing_model():
    """Test model: token counts in 64 buckets, by the first four hex digits of the MD5."""
    import hashlib
    import re
    from functools import lru_cache

    import numpy as np

    @lru_cache(maxsize=100_000)
    def bucket(token):
        return int(hashlib.md5(token).hexdigest()[:4], 16) % DIM

    # variants of a text come one batch after the other; its words are counted for the first
    @lru_cache(maxsize=2 * BATCH_SIZE)
    def counted(text):
        raw = text.encode()
        # a vertical tab, unlike the other white space of bytes, belongs to a token
        tokens = raw.split() if b"\v" not in raw else [t for t in re.split(rb"[ \t\n\r\f]+", raw) if t]
        found = np.fromiter(map(bucket, tokens), np.int64, len(tokens))
        return np.bincount(found, minlength=DIM).astype(np.float64)

    def run(texts, variants):
        return [counted(text) * (1.0 + variant) for text, variant in zip(texts, variants)]

    return run


_TOKEN_COUNTS = """tokens AS (
        SELECT doc_id, CAST('0x' || substr(md5(token), 1, 4) AS INTEGER) % 64 AS b
        FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS token FROM documents)
        WHERE token <> ''),
    counts AS (SELECT doc_id, b, count(*) AS n FROM tokens GROUP BY doc_id, b),
    text_vectors AS (
        SELECT doc_id, list(coalesce(n, 0)::DOUBLE ORDER BY b) AS t
        FROM (SELECT doc_id, unnest(range(64)) AS b FROM documents) LEFT JOIN counts USING (doc_id, b)
        GROUP BY doc_id)"""


_EMBEDDED = f"""WITH {_TOKEN_COUNTS}
    SELECT doc_id, {_fixed("list_transform(t, lambda x: x * 2.5::DOUBLE)")} AS vector FROM text_vectors"""


@query(_EMBEDDED)
def embed_hash(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    embedded = embed(docs, "text", hashing_model, DIM, variants=4)
    return embedded.select("doc_id", fixed_point(F.col("embedding")).alias("vector"))


@query(_EMBEDDED)
def embed_by_content(spark, sf):
    """Copies of a text are embedded once."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    embedded = embed_distinct(docs, "text", hashing_model, DIM, variants=4)
    return embedded.select("doc_id", fixed_point(F.col("embedding")).alias("vector"))


def _with_copies(spark, sf) -> DataFrame:
    """Every vector and a scaled copy of it under a later id."""
    originals = _embeddings(spark, sf).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")
    )
    copies = originals.select(
        (F.col("vec_id") + COPY_OFFSET).alias("vec_id"),
        F.transform("embedding", lambda x: x * 1.01).alias("embedding"),
    )
    return originals.unionByName(copies)


_FIRST_OF_SET = f"""first_of AS (
        SELECT min(vec_id) AS vec_id FROM e GROUP BY list_sort({_TOP_DIMS}))"""


@query(
    f"""WITH {_SQL_BASE}, {_FIRST_OF_SET}, a AS (
        SELECT vec_id FROM e UNION ALL SELECT vec_id + {COPY_OFFSET} FROM e)
    SELECT vec_id, vec_id IN (SELECT vec_id FROM first_of) AS kept FROM a"""
)
def near_dup_drop(spark, sf):
    buckets = signature_buckets(F.col("embedding"), TOP_M)
    kept, dropped = drop_near_dups(_with_copies(spark, sf), "vec_id", buckets)
    return kept.select("vec_id", F.lit(True).alias("kept")).unionByName(
        dropped.select("vec_id", F.lit(False).alias("kept"))
    )


SHINGLE, SIMILAR = 5, 0.8


def word_runs(text: str):
    """Hashes of all runs of five words of a whole text, or the one run of fewer; null without words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"\S+"), F.lit(0))

    def runs(w):
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
        found = F.transform(starts, lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, SHINGLE))))
        return F.when(F.size(w) > 0, F.array_distinct(found))

    # as a variable of a lambda, the list of words is made once and not for every run
    return F.transform(F.array(words), runs)[0]


@query()
def near_dup_texts(spark, sf):
    """The greedy walk over whole texts, decided by rounds alone."""
    bands, rows = band_layout(SIMILAR)
    runs = stage(table(spark, sf, "documents").select("doc_id", word_runs("text").alias("runs")), "runs")
    docs = stage(runs.select("doc_id", band_keys(F.col("runs"), bands=bands, rows=rows).alias("buckets")), "signed")
    kept, dropped = drop_near_dups(docs, "doc_id", F.col("buckets"), tail_rows=0)
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(
        dropped.select("doc_id", F.lit(False).alias("kept"))
    )


def _image_vectors(spark, sf) -> DataFrame:
    """Mean vector per image URL over four variants of every embedding."""
    variants = fan_out(_embeddings(spark, sf), 4)
    shifted = F.transform(
        "embedding", lambda x: x.cast("double") * (1 + F.col("variant_no") * F.lit(0.1))
    )
    url = F.concat(F.lit("http://host.example/"), F.col("vec_id"), F.lit(".jpg"))
    images = variants.select(url.alias("image_url"), shifted.alias("embedding"))
    return vec_mean(images, "image_url", dim=DIM)


_SQL_ENTRIES = f"""WITH {_SQL_BASE}, r AS (
        SELECT doc_id, reason, source || '-' || doc_id AS id, source, n_chars, vec_id, v
        FROM ({REASON_SQL}) LEFT JOIN e ON vec_id = doc_id)"""


@query(
    f"""{_SQL_ENTRIES}
    SELECT doc_id + 1 AS line_no, CASE WHEN coalesce(reason, '') = '' AND v IS NOT NULL THEN id END AS id,
        CASE WHEN reason IS NOT NULL THEN reason WHEN v IS NULL THEN 'embedding_failed' ELSE 'ok' END
            AS status,
        CASE WHEN reason IS NULL AND v IS NOT NULL
             THEN {_fixed("list_transform(v, lambda x: x * 1.15::DOUBLE)")} END AS vector,
        CASE WHEN reason IS NULL AND v IS NOT NULL THEN 'description,image_url,n_chars,name' END AS keys
    FROM r"""
)
def index_simple(spark, sf):
    entries, rejects = simple_entries(document_lines(spark, sf), _image_vectors(spark, sf), DIM)
    done = entries.select(
        "line_no",
        "id",
        F.lit("ok").alias("status"),
        fixed_point(F.col("embedding")).alias("vector"),
        F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"),
    )
    null = F.lit(None).cast("string")
    return done.unionByName(
        rejects.select(
            "line_no",
            null.alias("id"),
            F.col("reason").alias("status"),
            null.alias("vector"),
            null.alias("keys"),
        )
    )


@query(
    f"""{_SQL_ENTRIES}, ok AS (SELECT * FROM r WHERE reason IS NULL AND v IS NOT NULL),
    first_of AS (SELECT min(doc_id) AS doc_id FROM ok GROUP BY list_sort({_TOP_DIMS})),
    {_TOKEN_COUNTS}
    SELECT doc_id + 1 AS line_no, id, {_fixed(
        "list_transform(range(1, 65), lambda i: v[i] * 1.15::DOUBLE * 0.7::DOUBLE + t[i] * 0.3::DOUBLE)"
    )} AS vector, 'n_chars,name' AS keys, 'ok' AS status
    FROM ok JOIN first_of USING (doc_id) JOIN text_vectors USING (doc_id)
    UNION ALL
    SELECT doc_id + 1, NULL, NULL, NULL,
        CASE WHEN reason IS NOT NULL THEN reason WHEN v IS NULL THEN 'embedding_failed'
             ELSE 'near_duplicate' END
    FROM r WHERE doc_id NOT IN (SELECT doc_id FROM first_of)"""
)
def index_full(spark, sf):
    entries, rejects = full_entries(
        document_lines(spark, sf), _image_vectors(spark, sf), hashing_model, DIM, TOP_M
    )
    null = F.lit(None).cast("string")
    done = entries.select(
        "line_no",
        "id",
        fixed_point(F.col("embedding")).alias("vector"),
        F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"),
        F.lit("ok").alias("status"),
    )
    return done.unionByName(
        rejects.select(
            "line_no", null.alias("id"), null.alias("vector"), null.alias("keys"), F.col("reason").alias("status")
        )
    )


@query(
    f"""WITH {_SQL_BASE}, f AS (
        SELECT doc_id, v, 'p-' || doc_id // 3 AS id, list_sort({_TOP_DIMS}) AS dims
        FROM documents JOIN e ON vec_id = doc_id % (SELECT count(*) - 100 FROM e)),
    a AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM f),
    walk AS (
        WITH RECURSIVE w(n, taken, ids, reason) AS (
            SELECT 0::BIGINT, []::INTEGER[][], []::VARCHAR[], ''
            UNION ALL
            SELECT a.n,
                CASE WHEN list_contains(taken, dims) OR list_contains(ids, id) THEN taken
                     ELSE list_append(taken, dims::INTEGER[]) END,
                CASE WHEN list_contains(taken, dims) OR list_contains(ids, id) THEN ids
                     ELSE list_append(ids, id) END,
                CASE WHEN list_contains(taken, dims::INTEGER[]) THEN 'near_duplicate'
                     WHEN list_contains(ids, id) THEN 'duplicate_id' ELSE 'ok' END
            FROM w JOIN a ON a.n = w.n + 1)
        SELECT * FROM w)
    SELECT doc_id + 1 AS line_no, reason AS status FROM walk JOIN a USING (n)"""
)
def index_full_reasons(spark, sf):
    """The full flow over lines of which many repeat a vector or an id; reasons in its order."""
    docs = table(spark, sf, "documents").select("doc_id")
    n_vectors = _embeddings(spark, sf).count() - 100
    url = F.concat(F.lit("u"), (F.col("doc_id") % n_vectors))
    record = F.struct(
        F.concat(F.lit("p-"), F.floor(F.col("doc_id") / 3)).alias("name"),
        url.alias("image_url"),
        F.lit("t").alias("description"),
    )
    lines = docs.select((F.col("doc_id") + 1).alias("line_no"), F.to_json(record).alias("raw"))
    vectors = _embeddings(spark, sf).select(
        F.concat(F.lit("u"), "vec_id").alias("image_url"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    entries, rejects = full_entries(lines, vectors, hashing_model, DIM, TOP_M)
    return entries.select("line_no", F.lit("ok").alias("status")).unionByName(
        rejects.select("line_no", F.col("reason").alias("status"))
    )


@query(
    f"""{_SQL_ENTRIES}
    SELECT doc_id // 128 AS batch_no, count(*) AS n_lines,
        count(*) FILTER (reason IS NULL AND v IS NOT NULL) AS n_indexed
    FROM r GROUP BY 1"""
)
def index_batch_counts(spark, sf):
    lines = stage(document_lines(spark, sf), "lines")
    entries, _ = simple_entries(lines, _image_vectors(spark, sf), DIM)
    return indexed_per_batch(lines, entries)


@query(
    f"""WITH {_SQL_BASE}, {_TOKEN_COUNTS},
    s AS (SELECT doc_id AS query_id, vec_id, list_cosine_similarity(v, t) AS score
          FROM text_vectors, e JOIN part ON p_partkey = vec_id
          WHERE p_type = 'SMALL' AND p_retailprice < 950 AND list_dot_product(t, t) > 0)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS VARCHAR) AS id, round(score, 6) AS score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS rank
          FROM s) WHERE rank <= 3"""
)
def search_variants(spark, sf):
    """Every document as a query of four variants against the stored parts."""
    filters = {"category": "string", "price": "double"}
    index = ensure_index(spark, scratch_path(spark, "indexes"), "parts", DIM, filters=filters)
    index.upsert(_part_entries(spark, sf), "vec_id")
    values = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("value"))
    conditions = {"category": {"$eq": "SMALL"}, "price": {"$lt": 950}}
    found = search_values(index, values, hashing_model, 3, 4, conditions)
    return found.withColumn("score", F.round("score", 6))


def _part_entries(spark, sf) -> DataFrame:
    """Index entries from embeddings with part attributes as dynamic metadata."""
    metadata = F.to_variant_object(
        F.struct(
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("price"),
        )
    )
    return _with_part(spark, sf).select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.try_variant_get(metadata, "$", "map<string,variant>").alias("metadata"),
        "vec_id",
        "label",
    )


@query(
    f"""WITH {_SQL_BASE}
    SELECT CAST(vec_id AS VARCHAR) AS id, p_name AS name,
        {_fixed("list_transform(v, lambda x: CASE WHEN label < 5 THEN x * 3 ELSE x END)")} AS vector
    FROM e LEFT JOIN part ON p_partkey = vec_id"""
)
def index_upsert(spark, sf):
    entries = _part_entries(spark, sf)
    root = scratch_path(spark, "indexes")
    index = ensure_index(spark, root, "parts", DIM)
    index.upsert(entries, "vec_id")
    twice = F.explode(F.array(F.lit(3), F.lit(2)))
    changed = entries.filter("label < 5").withColumn("sequence", twice)
    grown = F.transform("embedding", lambda x: x * F.col("sequence"))
    index.upsert(changed.withColumn("embedding", grown), "sequence")
    return (
        open_index(spark, root, "parts")
        .read()
        .select(
            "id",
            text_field(F.col("metadata"), "name").alias("name"),
            fixed_point(F.col("embedding")).alias("vector"),
        )
    )


@query(
    f"""WITH {_SQL_BASE}, {_SQL_QUERY}, t AS (
        SELECT CAST(vec_id AS VARCHAR) AS id, list_cosine_similarity(v, q) AS score, p_name, p_type
        FROM e JOIN part ON p_partkey = vec_id, q
        WHERE p_type = 'SMALL' AND p_retailprice < 950
        ORDER BY score DESC, id LIMIT 5)
    SELECT CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank, id,
        printf('%.4f', score) AS score_text, p_name AS name, p_type AS category
    FROM t"""
)
def search_shown(spark, sf):
    root = scratch_path(spark, "indexes")
    filters = {"category": "string", "price": "double"}
    index = ensure_index(spark, root, "parts", DIM, filters=filters)
    index.upsert(_part_entries(spark, sf), "vec_id")
    conditions = {"category": {"$eq": "SMALL"}, "price": {"$lt": 950}}
    shown = search_index(index, _label_mean(spark, sf), 5, conditions)
    return shown.select(
        "rank",
        "id",
        "score_text",
        F.try_element_at("shown", F.lit("name")).alias("name"),
        F.try_element_at("shown", F.lit("category")).alias("category"),
    )


@query(f"SELECT doc_id, coalesce(reason, 'ok') AS reason FROM ({REASON_SQL})")
def stream_clean(spark, sf):
    """The lines of ``validate_reason`` as files of a stream; the id travels in the record."""
    folder, out = scratch_path(spark, "arrivals"), scratch_path(spark, "arrived")
    lines = document_lines(spark, sf)
    with_id = F.concat(F.lit('{"doc_id":'), "doc_id", F.lit(',"name"'))
    lines.select(F.regexp_replace("raw", r'\{"name"', with_id).alias("value")).write.text(folder)
    stream = stream_records(spark, folder).select(
        F.regexp_extract("raw", r'"doc_id":(\d+)', 1).cast("long").alias("doc_id"),
        F.coalesce("reason", F.lit("ok")).alias("reason"),
    )
    run_available(stream, scratch_path(spark, "stream-state"), out)
    return spark.read.schema("doc_id long, reason string").parquet(out)


def _in_arrivals(spark, df: DataFrame, order: str, schema: str, run, arrivals: int = 3) -> None:
    """Feed ``df`` to a stream in consecutive ranges of ``order``, as files arriving over time.

    ``run`` is called with the stream after every arrival and picks up from its checkpoint.
    """
    folder = scratch_path(spark, "arrivals")
    cuts = df.approxQuantile(order, [n / arrivals for n in range(1, arrivals)], 0.01)
    bounds = [float("-inf"), *cuts, float("inf")]
    for low, high in zip(bounds, bounds[1:]):
        write_records(df.filter((F.col(order) > low) & (F.col(order) <= high)), folder)
        run(spark.readStream.schema(schema).json(folder))


@query(
    "SELECT CAST(label AS VARCHAR) AS id, max(vec_id) AS vec_id FROM embeddings GROUP BY 1"
)
def stream_index_upsert(spark, sf):
    vectors = _embeddings(spark, sf)
    index = ensure_index(spark, scratch_path(spark, "indexes"), "stream", DIM)
    checkpoint = scratch_path(spark, "stream-state")

    def run(stream):
        metadata = F.to_variant_object(F.struct("vec_id"))
        entries = stream.select(
            F.col("label").cast("string").alias("id"),
            "embedding",
            F.try_variant_get(metadata, "$", "map<string,variant>").alias("metadata"),
            "vec_id",
        )
        stream_upsert(entries, index, "vec_id", checkpoint)

    schema = "vec_id long, embedding array<double>, label int"
    _in_arrivals(spark, vectors, "vec_id", schema, run)
    latest = F.try_variant_get(F.try_element_at("metadata", F.lit("vec_id")), "$", "long")
    return index.read().select("id", latest.alias("vec_id"))


@query(f"WITH {_SQL_BASE}, {_FIRST_OF_SET} SELECT vec_id FROM first_of")
def stream_near_dups(spark, sf):
    rows = _with_copies(spark, sf)
    state, out = scratch_path(spark, "bucket-state"), scratch_path(spark, "survivors")
    buckets = signature_buckets(F.col("embedding"), TOP_M)
    checkpoint = scratch_path(spark, "stream-state")
    _in_arrivals(
        spark, rows, "vec_id", "vec_id long, embedding array<double>",
        lambda stream: stream_drop_near_dups(stream, "vec_id", buckets, state, out, checkpoint),
    )
    return spark.read.schema("vec_id long").parquet(out).select("vec_id")


def _two_streams(spark, rows: DataFrame, order: str, schema: str, run) -> None:
    """Feed even and odd ``order`` as two streams in turn, each with its own checkpoint."""
    parts = [(rows.filter(F.col(order) % 2 == n), scratch_path(spark, "stream-state")) for n in (0, 1)]
    folders = [scratch_path(spark, "arrivals") for _ in parts]
    middle = rows.agg(F.max(order)).first()[0] // 2
    for late in (False, True):
        for (part, checkpoint), folder in zip(parts, folders):
            write_records(part.filter((F.col(order) > middle) == F.lit(late)), folder)
            run(spark.readStream.schema(schema).json(folder), checkpoint)


@query(
    "SELECT label || '-' || vec_id % 7 AS id, max(vec_id) AS vec_id FROM embeddings GROUP BY 1"
)
def stream_two_writers(spark, sf):
    """Two streams into one index; an older batch arriving later replaces nothing newer."""
    index = ensure_index(spark, scratch_path(spark, "indexes"), "stream", DIM)

    def run(stream, checkpoint):
        metadata = F.to_variant_object(F.struct("vec_id"))
        entries = stream.select(
            F.concat_ws("-", "label", (F.col("vec_id") % 7).cast("string")).alias("id"),
            "embedding",
            F.try_variant_get(metadata, "$", "map<string,variant>").alias("metadata"),
            "vec_id",
        )
        stream_upsert(entries, index, "vec_id", checkpoint)

    vectors = _embeddings(spark, sf)
    _two_streams(spark, vectors, "vec_id", "vec_id long, embedding array<double>, label int", run)
    latest = F.try_variant_get(F.try_element_at("metadata", F.lit("vec_id")), "$", "long")
    return index.read().select("id", latest.alias("vec_id"))


@query(
    f"""WITH {_SQL_BASE}, a AS (
        SELECT vec_id, list_sort({_TOP_DIMS}) AS dims FROM e
        UNION ALL SELECT vec_id + {COPY_OFFSET}, list_sort({_TOP_DIMS}) FROM e),
    m AS (SELECT max(vec_id) // 2 AS middle FROM a)
    SELECT vec_id FROM a, m QUALIFY row_number() OVER (
        PARTITION BY dims ORDER BY vec_id > middle, vec_id % 2, vec_id) = 1"""
)
def stream_near_dups_two(spark, sf):
    """Two streams that share one bucket state and one output; both keep their own rows."""
    state, out = scratch_path(spark, "bucket-state"), scratch_path(spark, "survivors")
    buckets = signature_buckets(F.col("embedding"), TOP_M)
    _two_streams(
        spark, _with_copies(spark, sf), "vec_id", "vec_id long, embedding array<double>",
        lambda stream, checkpoint: stream_drop_near_dups(stream, "vec_id", buckets, state, out, checkpoint),
    )
    return spark.read.schema("vec_id long").parquet(out).select("vec_id")
