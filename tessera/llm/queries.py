"""The queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bagminhash, bitsliced, html_text, kneser_ney, packing, pieces, quality, rabitq, revisits, toxicity
from tessera.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures_of(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", revisits.header_lines(F.col("headers")))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.search(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.lengths(table(spark, sf_dir, "documents")))


#: The model file of a public tokenizer; a parameter, never part of this repository.
PIECES = os.environ.get("TESSERA_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.search(table(spark, sf_dir, "embeddings"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(table(spark, sf_dir, "documents"))


#: The order of the language model.
ORDER = 3


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_all(table(spark, sf_dir, "documents"), order=ORDER)


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_html": op3_html,
    "op4_revisits": op4_revisits,
    "op5_neighbours": op5_neighbours,
    "op6_packing": op6_packing,
    "op7_pieces": op7_pieces,
    "op8_topk": op8_topk,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_language_model": op10_language_model,
}
#: Whole tables, as the queries; the index may find other rows than these where recall is below one.
ORACLE_SQL: dict[str, str] = {
    "op4_revisits": r"""
        WITH p AS (
            SELECT page_id, page_id % 7 AS kind, '"' || md5(coalesce(html, '')) || '"' AS tag, length(coalesce(html, '')) AS size, 'day ' || (page_id // 10) AS day,
                   regexp_replace(trim(url), '#.*$', '') AS asked, regexp_replace(url, '[#?].*$', '') AS address, regexp_extract(url, '(\?[^#]*)', 1) AS question FROM pages
        ), a AS (
            SELECT *, asked AS first_url, address || CASE WHEN kind = 4 THEN '/never-' || page_id ELSE question END AS again_url FROM p
        ), l AS (
            SELECT *, false AS again, first_url AS u FROM a UNION ALL SELECT *, true, again_url FROM a
        ), b AS (SELECT *, regexp_replace(trim(u), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM l),
        k AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
                   || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS place,
                   array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(regexp_extract(x, '^([^=]*)', 1))
                   NOT IN ('ref', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'sessionid'))), '&') AS query
            FROM b
        ), r AS (SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM k),
        j AS (
            SELECT v.page_id, v.url_key, v.kind, v.tag, v.day, f.page_id AS source, f.kind AS source_kind, f.tag AS source_tag, f.day AS source_day, f.size AS source_size,
                   row_number() OVER (PARTITION BY v.page_id ORDER BY f.page_id DESC) AS n
            FROM r AS v LEFT JOIN r AS f ON NOT f.again AND f.url_key = v.url_key AND f.url_key <> '' AND f.page_id < v.page_id + 500 WHERE v.again
        ), o AS (
            SELECT *, CASE WHEN source IS NULL THEN 'orphan' WHEN source_kind = 3 OR kind = 2 THEN 'unverified'
                   WHEN kind = 1 THEN CASE WHEN day = source_day THEN 'resolved' ELSE 'mismatch' END WHEN kind <> 5 AND tag = source_tag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j WHERE n = 1
        )
        SELECT page_id * 2 + 1 AS record_id, url_key, page_id + 500 AS ts, outcome, source * 2 AS source_id, source AS source_ts,
               CASE WHEN outcome IN ('resolved', 'unverified') THEN array_to_string(list_filter(['content-length: ' || source_size, 'content-type: text/html', 'date: ' || (page_id + 500),
                   'etag: ' || CASE WHEN kind = 5 THEN '"stale"' WHEN kind NOT IN (1, 2) THEN 'W/' || tag WHEN source_kind <> 3 THEN source_tag END,
                   'last-modified: ' || CASE WHEN source_kind <> 3 THEN source_day END, 'x-cache: revalidated'], lambda x: x IS NOT NULL), chr(10)) END AS headers
        FROM o
    """,
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.x::DOUBLE[], v.x::DOUBLE[])::BIGINT AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
