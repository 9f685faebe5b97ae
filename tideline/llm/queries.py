"""The registered queries of the training-data operators, with production parameters, and SQL where it can
express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, decontaminate, licenses, near_dedup, secrets, stream_dedup, token_counts, token_store, toxicity, warc
from tideline.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; what it holds in one language is a repository."""
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), repo="concat_ws('/', source, lang)", owner="source")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_verify(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), words=4)


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.match_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_texts(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_token_store, op3_near_dedup, op4_warc_round_trip, op5_stream_dedup, op6_decontamination,
        op7_token_counts, op8_bpe_replay, op9_toxicity, op10_license_scan,
    )
}

#: Only A-Z are lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op3_near_dedup": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')))
              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles FROM d),
        x AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
        e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach(doc_id, node) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.node),
        m AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY 1)
        SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON m.doc_id = s.doc_id
    """,
    "op6_decontamination": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
        i AS MATERIALIZED (SELECT DISTINCT item, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda k: array_to_string(w[k:k + least(len(w), 10) - 1], ' '))) AS win FROM b WHERE len(w) > 0),
        o AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS k, w FROM d, (SELECT DISTINCT size FROM i) WHERE len(w) >= size),
        h AS MATERIALIZED (SELECT o.r, o.k, o.size, i.item FROM o JOIN i ON i.size = o.size AND i.win = array_to_string(o.w[o.k:o.k + o.size - 1], ' ')),
        n AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS place FROM h) GROUP BY 1),
        t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM h) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN t ON t.r = d.r
    """,
    "op4_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        k AS (SELECT html, max(page_id) AS keeper FROM p WHERE strlen(html) >= 1000 GROUP BY html)
        SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
        FROM p LEFT JOIN k ON k.html = p.html
    """,
    "op5_stream_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents),
        g AS (SELECT text, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
        FROM t JOIN g ON t.text = g.text
    """,
}
