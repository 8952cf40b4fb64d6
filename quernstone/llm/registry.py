"""The registered queries of the subpackage, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, language, minhash, ngrams, packing, pages, quality, repeats, tokens, topk
from .common import table

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PACK_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(spark, table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(table(spark, sf_dir, "documents"), MULTI_RANKS, public_tokenizers.PATTERN)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), PACK_VOCABULARY, public_tokenizers.PATTERN)


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.score(spark, table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the declared language is `lang`, the host is `source`."""
    out = language.identify_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "language", "confidence", "accepted")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: the same fusion with markup language, address suffix and host."""
    return language.identify_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "language", "confidence", "accepted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_html_extraction": op3_html_extraction,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_stupid_backoff": op6_stupid_backoff,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_ivf_pq": op8_ivf_pq,
    "op9_block_topk": op9_block_topk,
    "op10_language_id": op10_language_id,
    "language_id_pages": language_id_pages,
}
ORACLE_SQL: dict[str, str] = {
    "op4_minhash_near_dedup": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN ['  ' || array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * shared.n >= 75 * (p.n + q.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
""",
    "op6_stupid_backoff": """
WITH words AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
tokens AS (
  SELECT r, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS v
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
total AS (SELECT count(*) AS n FROM tokens),
heads AS (SELECT r, w FROM tokens UNION ALL SELECT r, NULL FROM words WHERE len(w) > 0),
word_n AS (SELECT w, count(*) AS n FROM heads GROUP BY w),
word_own AS (SELECT r, w, count(*) AS n FROM heads GROUP BY r, w),
pair_n AS (SELECT v, w, count(*) AS n FROM tokens GROUP BY v, w),
pair_own AS (SELECT r, v, w, count(*) AS n FROM tokens GROUP BY r, v, w),
counted AS (
  SELECT t.r, p.n - po.n AS c_pair, a.n - ao.n AS c_word, b.n - bo.n AS c_before, total.n - len(d.w) AS rest
  FROM tokens t CROSS JOIN total
  JOIN words d ON d.r = t.r
  JOIN pair_n p ON p.v IS NOT DISTINCT FROM t.v AND p.w = t.w
  JOIN pair_own po ON po.r = t.r AND po.v IS NOT DISTINCT FROM t.v AND po.w = t.w
  JOIN word_n a ON a.w = t.w JOIN word_own ao ON ao.r = t.r AND ao.w = t.w
  JOIN word_n b ON b.w IS NOT DISTINCT FROM t.v JOIN word_own bo ON bo.r = t.r AND bo.w IS NOT DISTINCT FROM t.v),
sums AS (
  SELECT r, count(*) FILTER (c_pair > 0) AS n_bigram, count(*) FILTER (c_pair <= 0 AND c_word > 0) AS n_word,
         count(*) FILTER (c_pair <= 0 AND c_word <= 0) AS n_unseen,
         sum(ln(CASE WHEN c_pair > 0 THEN c_pair / c_before::DOUBLE WHEN c_word > 0 THEN 0.4e0 * c_word / rest ELSE 0.4e0 * 0.5e0 / (rest + 1) END)) AS s
  FROM counted GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(s.n_bigram, 0)::BIGINT AS n_bigram, coalesce(s.n_word, 0)::BIGINT AS n_word,
       coalesce(s.n_unseen, 0)::BIGINT AS n_unseen, round(coalesce(s.s, 0e0), 4) AS log_score
FROM words d LEFT JOIN sums s ON s.r = d.r
""",
    "op9_block_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5
""",
}
