"""The dealt operators as queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import bpe, bwt_dedup, decontaminate, fill_middle, html_render, jaccard_rtree, language_codes, license_votes, quality_forest, simhash_index, source_audit, substring_dedup, toxicity_fm

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op9_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_forest.train(docs, table(spark, sf_dir, "labels"))
    return quality_forest.score_documents(docs, model)


@query
def op5_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_fm.score_documents(docs, toxicity_fm.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_codes.predict(docs, language_codes.train(docs))


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op4_decontaminate"] = r"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM documents
), b AS (
    SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
    FROM benchmark WHERE item_id IS NOT NULL
), w AS (
    SELECT DISTINCT item_id, words[i : i + least(len(words), 13) - 1] AS ws, least(len(words), 13) AS n
    FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT n FROM w),
p AS (
    SELECT doc_id, n, i, words[i : i + n - 1] AS ws
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)
), h AS (
    SELECT DISTINCT p.doc_id, p.n, p.i, w.item_id FROM p JOIN w ON p.n = w.n AND p.ws = w.ws
), hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(words), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query
def op10_license_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_votes.license_labels(table(spark, sf_dir, "documents"))


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicated(table(spark, sf_dir, "documents"), digest=True)


@query
def op8_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.deduplicated(table(spark, sf_dir, "documents"), digest=True)


@query
def op3_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_rtree.jaccard_components(table(spark, sf_dir, "documents")).drop("version")


@query
def op2_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_render.extract(table(spark, sf_dir, "pages"))


@query
def op11_roaring_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(table(spark, sf_dir, "documents")))


ORACLES["op11_roaring_fim"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
        sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex FROM documents
), h AS (
    SELECT doc_id, text, tokens, CAST(len(tokens) AS BIGINT) AS n,
        CAST('0x' || substr(hex, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(hex, 9, 8) AS BIGINT) AS h2,
        CAST('0x' || substr(hex, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(hex, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
    SELECT doc_id, text, n, tokens, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
             WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
    SELECT doc_id, text, n, form, array_to_string(tokens[1 : a], '') AS prefix,
        array_to_string(tokens[a + 1 : b], '') AS middle, array_to_string(tokens[b + 1 :], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                     ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op12_source_divergence"] = r"""
WITH d AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), t AS (SELECT lang, source, id, unnest(terms) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(docs) >= 10),
v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS size, CAST(sum(n) AS HUGEINT) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (
    SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n, CAST(k.n AS HUGEINT) AS n_lang
    FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), s AS (SELECT lang, source, sum(n) AS total FROM w GROUP BY lang, source),
p AS (
    SELECT w.lang, w.source, w.term, w.n, 1 + (1000000000 * (w.n + 2)) // (s.total + 2 * v.size) AS p,
        1 + (1000000000 * (w.n_lang + 2)) // (v.total + 2 * v.size) AS q
    FROM w JOIN s ON w.lang = s.lang AND w.source = s.source JOIN v ON w.lang = v.lang
), f AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), term AS (
    SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 10
"""


@query
def op13_simhash_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_index.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_index.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")
