"""The queries of this subpackage, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clearway.llm import digest, html_text, language_model, packing, pieces, quality, runs, secret_scan, simhash, toxicity, url_rules, vectors, whitening
from clearway.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality.fit(docs, labels.where(fold("doc_id", 5) != 0))
    return quality.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


QUALITY_THRESHOLD = 0.3


def fold(id_col: str, folds: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


@query
def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return digest.digests_with_next(table(spark, folder, "documents"))


@query
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.span_digest(secret_scan.find_secrets(table(spark, folder, "documents")))


@query
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = tokenizer_path("piece_bpe_32k.model")
    decoded = pieces.encode_and_decode(table(spark, folder, "documents"), vocabulary)
    return decoded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op6_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


TOXIC_THRESHOLD = 0.7


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.fit(docs, labels.where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))


# The table has no unusable vectors and no cosines near the threshold.
SQL["op6_embeddings"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b
)
SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, min(r.b) = r.a AS kept
FROM reach AS r LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) AS n ON n.a = r.a GROUP BY r.a
"""


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, folder, "pages"), rules)


SQL["op8_url_filters"] = """
WITH parts AS (
    SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
    SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM (SELECT page_id, coalesce(rest, '') AS rest FROM parts)
), ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM cut
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""


@query
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op10_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


# Not a general extraction: the pages of the table have one article each, made of headings, paragraphs and line breaks.
SQL["op10_html_extraction"] = """
WITH parts AS (
    SELECT page_id, url, string_split_regex(
        replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' '), '</?(?:p|h1)>') AS parts
    FROM pages
), blocks AS (
    SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]*>', '', 'g'),
        '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) FOR x IN parts] AS blocks
    FROM parts
), texts AS (
    SELECT page_id, url, array_to_string([x FOR x IN blocks IF x <> ''], chr(10)) AS text FROM blocks
)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""


@query
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.longest_run(runs.periodic_runs(table(spark, folder, "documents"), edit=True, digest=True))


@query
def op11_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    # Of the nine tenths that are learned from, one tenth is deleted from the counts while the weights are learned.
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    scored = language_model.score(table(spark, folder, "documents"), training=h % 10 != 0, deleted=F.floor(h / 10) % 10 == 0)
    return scored.withColumn("held_out", fold("doc_id", 10) == 0)


# Two equal six-word stretches one period apart lie in every run, as a run of q has at least max(12, 2 q) - q words that are equal to those q later.
SQL["op13_periodic_runs"] = """
WITH hashed AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t-\\r]+'), lambda w: w <> '') AS w,
           xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS h
    FROM documents
), cut AS (
    SELECT doc_id, w, len(w) AS n, h, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), docs AS (
    SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
        lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w
    FROM cut
), grams AS (
    SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM docs, unnest(range(n - 5)) AS u(i)
), matched AS (
    SELECT x.doc_id, y.i - x.i AS q, x.i FROM grams AS x JOIN grams AS y ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
), stretches AS (
    SELECT doc_id, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM matched)
    GROUP BY doc_id, q, island
), runs AS (
    SELECT doc_id, s, e, min(q) AS q FROM stretches WHERE e - s >= greatest(12, 2 * q) GROUP BY doc_id, s, e
), found AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(concat(s, ',', e - s, ',', q, chr(10)), '' ORDER BY s, q) AS lines,
           list({'s': s, 'l': e - s, 'q': q} ORDER BY e - s DESC, s, q)[1] AS best
    FROM runs GROUP BY doc_id
), gone AS (
    SELECT DISTINCT doc_id, i FROM runs, unnest(range(s + q, e)) AS u(i)
), kept AS (
    SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS words
    FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM docs) AS p ANTI JOIN gone ON gone.doc_id = p.doc_id AND gone.i = p.i
    GROUP BY p.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM docs AS d LEFT JOIN found AS f ON f.doc_id = d.doc_id LEFT JOIN kept AS k ON k.doc_id = d.doc_id
"""
