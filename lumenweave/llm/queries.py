"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenweave.llm import bpe, langid, packing, pages, prints, quality, shards, simhash, urls, warc
from lumenweave.llm.shared import table


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.MEASURES, "base_failed", "kept")

#: The vocabulary of the registered queries.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints.compare_edits(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs)).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_packing": op2_packing,
    "op3_fingerprints": op3_fingerprints,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_url_filters": op6_url_filters,
    "op7_sharding": op7_sharding,
    "op10_warc": op10_warc,
    "op8_bpe": op8_bpe,
    "op9_quality_rules": op9_quality_rules,
}

ORACLES = {
    "op6_url_filters": r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
 h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
 p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
 f AS (SELECT *, '.' || host AS dotted FROM p),
 g AS (SELECT page_id, host, path,
    CASE WHEN suffix(dotted, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN suffix(dotted, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN suffix(dotted, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN suffix(dotted, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM f)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM g""",
    "op10_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
 d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
 m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to FROM m""",
    "op9_quality_rules": r"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 pos AS (SELECT rid, unnest(words) AS a, generate_subscripts(words, 1) AS i FROM w),
 tri AS (SELECT rid, i, a, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY rid ORDER BY i)),
 win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM tri WHERE c IS NOT NULL),
 cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY rid),
 lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM w),
 dup AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
 m AS (SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS up, length(regexp_replace(text, '[^\p{Ll}]', '', 'g')) AS low
       FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * up > up + low) AS kept
FROM m""",
}
