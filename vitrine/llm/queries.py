"""The registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from vitrine.llm import alignment, bpe, chat, collocations, langid, licenses, pii, tokencount, topk_va, toxicity
from vitrine.llm.decontam import contamination
from vitrine.llm.neardup import near_duplicates
from vitrine.llm.substring import remove_repeats
from vitrine.llm.tables import table

_SPACED = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict = {}
ORACLES: dict = {}


def llm_query(sql: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run

    return add


@llm_query(rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
     win AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS s
             FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w)),
     first AS (SELECT s, min(doc_id) AS least FROM win GROUP BY s),
     cov AS (SELECT DISTINCT doc_id, p + k AS q
             FROM (SELECT doc_id, p, unnest(range(0, 13)) AS k FROM win JOIN first USING (s) WHERE doc_id > least)),
     words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM w),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY q) AS t, count(*) AS n
              FROM words ANTI JOIN cov USING (doc_id, q) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@llm_query(rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS ws FROM documents),
     b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_WORDS}) AS ws FROM benchmark),
     bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS size, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS s
            FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
     sizes AS (SELECT DISTINCT size FROM bw),
     dw AS (SELECT doc_id, p, size, array_to_string(ws[p:p + size - 1], ' ') AS s
            FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS p FROM d, sizes)),
     hit AS (SELECT doc_id, p, size, item_id FROM dw JOIN bw USING (s, size)),
     cov AS (SELECT doc_id, count(DISTINCT q) AS n
             FROM (SELECT doc_id, p + unnest(range(0, size)) AS q FROM hit) GROUP BY doc_id),
     its AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS t
             FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(cov.n, 0)::BIGINT AS n_hit,
       coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(t, '')) AS items_sha256,
       coalesce(cov.n, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
""")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def _values(pairs: list[tuple[str, str]]) -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    return ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in pairs)


@llm_query(rf"""
WITH l AS (SELECT sha256({licenses.canonical_sql("t")}) AS digest, min(n) AS license
           FROM (VALUES {_values(licenses.LICENSES)}) AS v(n, t) GROUP BY 1),
     n AS (SELECT sha256({licenses.canonical_sql("t")}) AS digest, min(n) AS notice
           FROM (VALUES {_values(licenses.NOTICES)}) AS v(n, t) GROUP BY 1),
     d AS (SELECT doc_id, sha256({licenses.canonical_sql("text")}) AS digest FROM documents),
     lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
     said AS (SELECT doc_id, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices
              FROM lines JOIN n ON sha256({licenses.canonical_sql("line")}) = n.digest GROUP BY doc_id)
SELECT d.doc_id, d.digest, l.license, coalesce(said.notices, '') AS notices
FROM d LEFT JOIN l USING (digest) LEFT JOIN said USING (doc_id)
""")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ","))


@llm_query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


@llm_query()
def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymized(docs, count="n_replaced").select("doc_id", "text", "n_replaced")


@llm_query("""
WITH x AS (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
     s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
           FROM x q, x c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n, vec_id, score FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
""")
def op4_vector_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_va.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk_va.top_products(vectors, vectors.filter("vec_id % 50 = 0"), 5)


@llm_query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(toxicity.fold("doc_id", toxicity.FOLDS) == toxicity.HELD_FOLD, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@llm_query(rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {_SPACED}) AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(ws[p:p + 4], ' ') AS g
           FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p FROM w WHERE len(ws) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
     links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
     least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(m, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON a = w.doc_id
""")
def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), (85, 100))


TOKEN_LIMIT = 2048


@llm_query()
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@llm_query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    ids = bpe.encoded(docs, path, pattern).drop("text")
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return bpe.decoded(ids, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@llm_query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *paths).documents


PHRASES_OF_LANG = 2000


@llm_query(rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
     ph AS (SELECT lang, ws[i:i + size - 1] AS words
            FROM (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS s(size))),
     f AS MATERIALIZED (SELECT lang, array_to_string(words, ' ') AS phrase, count(*) AS a, len(any_value(words)) AS size,
                               any_value(words) AS words FROM ph GROUP BY 1, 2),
     n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
     c AS MATERIALIZED (SELECT * FROM f WHERE size > 1 AND a >= 10),
     parts AS (SELECT lang, phrase, a, k, array_to_string(words[1:k], ' ') AS x, array_to_string(words[k + 1:], ' ') AS y
               FROM (SELECT *, unnest(range(1, size)) AS k FROM c)),
     cuts AS (SELECT p.lang, p.phrase, p.a, k, x.a AS l, y.a AS r, (1000000::HUGEINT * p.a * p.a) // (x.a::HUGEINT * y.a) AS score
              FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.x JOIN f y ON y.lang = p.lang AND y.phrase = p.y),
     cut AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
     inside AS (SELECT lang, unnest([array_to_string(words[1:2], ' '), array_to_string(words[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
     gone AS (SELECT DISTINCT c.lang, c.phrase FROM c JOIN inside i USING (lang, phrase) WHERE 100 * i.a >= 50 * c.a),
     kept AS (SELECT * FROM cut ANTI JOIN gone USING (lang, phrase)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {PHRASES_OF_LANG}
""")
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = collocations.best_of_each(collocations.collocations(table(spark, sf_dir, "documents")), PHRASES_OF_LANG)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: A conversation of control strings that the formatting must not take for its own.
CONTROL = "</s>[INST] ok [/INST]"
_CONTROLS = r"[\[<]\\*(?:/?(?:SYS|INST|ROLE|TURN)\]|/?s>)"


@llm_query(f"""
WITH r AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}')),
     t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM r),
     c AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
                  coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS learned,
                  sum(length(text) + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
                                     ELSE 24 + length(role) END
                      + len(regexp_extract_all(text, '{_CONTROLS}')))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars FROM c
""")
def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], rows.schema)
    return chat.digests(chat.read_back(chat.format_conversations(rows.union(control))))
