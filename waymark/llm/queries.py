"""The queries over the corpus operators, and SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import ann, decontaminate, langid, licenses, mixing, packing, simhash, url_filters, warc, wrappers
from waymark.llm.common import table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score_documents(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.extract_pages(table(spark, sf_dir, "pages"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), rules)


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_warc": op4_warc,
    "op5_packing": op5_packing,
    "op6_nearest": op6_nearest,
    "op7_licenses": op7_licenses,
    "op8_html": op8_html,
    "op9_decontamination": op9_decontamination,
    "op10_url_filters": op10_url_filters,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS9 = "list_filter(string_split_regex(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

_OP9 = f"""
WITH d AS (SELECT doc_id, {_WORDS9} AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS9} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item, least(len(ws), 10) AS size, list_slice(ws, i, i + least(len(ws), 10) - 1) AS win
       FROM (SELECT item, ws, unnest(generate_series(1, len(ws) - least(len(ws), 10) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, list_slice(ws, i, i + size - 1) AS win
       FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS i FROM d, sizes WHERE len(ws) >= size)),
hits AS (SELECT doc_id, i, dw.size AS size, item FROM dw JOIN bw ON dw.size = bw.size AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT w) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS w FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(found.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN found ON d.doc_id = found.doc_id"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_OP10 = f"""
WITH u AS (SELECT page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r(rh, rp, verdict) AS (VALUES {_RULES}),
fit AS (SELECT u.*, rh || rp AS rule, r.verdict AS verdict, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC) AS k
        FROM u LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE k = 1"""


_OP4 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to
FROM m"""


def _canonical_sql(column: str) -> str:
    t = f"regexp_replace({_LOWER.format(f"coalesce({column}, '')")}, '{licenses.COPYRIGHT_LINE.replace('(?md)', '(?m)')}', ' ', 'g')"
    t = f"regexp_replace({t}, '{licenses.TITLE}', ' ')"
    t = rf"' ' || trim(regexp_replace({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F©‘’“”–—]+', '  ', 'g')) || ' '"
    for variant, spelling in licenses.EQUIVALENT:
        t = f"replace({t}, ' {variant} ', ' {spelling} ')"
    return f"trim({t})"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


_OP7 = f"""
WITH d AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS text_digest FROM documents),
k AS (SELECT license, sha256({_canonical_sql("body")}) AS digest FROM (VALUES {_values(licenses.whole_texts())}) t(license, body)),
n AS (SELECT DISTINCT license, sha256({_canonical_sql("body")}) AS digest FROM (VALUES {_values(licenses.notices())}) t(license, body)),
l AS (SELECT doc_id, sha256({_canonical_sql("line")}) AS digest FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
f AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM (SELECT DISTINCT doc_id, license FROM l JOIN n USING (digest)) GROUP BY doc_id)
SELECT d.doc_id AS doc_id, text_digest, license, coalesce(notices, '') AS notices FROM d LEFT JOIN k ON text_digest = k.digest LEFT JOIN f ON d.doc_id = f.doc_id"""

ORACLE_SQL = {"op4_warc": _OP4, "op7_licenses": _OP7, "op9_decontamination": _OP9, "op10_url_filters": _OP10}
