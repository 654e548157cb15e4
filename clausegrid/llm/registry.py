"""The queries of this subpackage's operators and the SQL that some of them are held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, byte_windows, divergence, filter_audit, fingerprints, languages, masked_lm, neardup, packing, sharding, substrings, token_counts, topk
from ._common import own_folder, table, text_of


def op1_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", languages.held_out())
    filters = languages.learn(docs.where(~F.col("held_out")))
    return languages.predict(docs.select("doc_id", "held_out", "text"), filters).drop("text")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.pseudo_likelihood(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op5_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: what remains of its text, and the stretches removed (code points, start-end, in order)."""
    out = substrings.dedup_units(table(spark, sf_dir, "documents").select("doc_id", "text"), unit="line")
    stretches = F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"]))
    gone = F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return out.select("doc_id", "text", gone.alias("removed_chars"), F.concat_ws(",", stretches).alias("removed_spans"))


def op6_dual_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op7_histogram_sort_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(text_of().cast("binary")).alias("text_crc32"))
    out = sharding.shard_rows(docs.select("doc_id", "text", "text_crc32"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document of the flat token files that are written for all documents."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.document_tokens(docs, own_folder(spark, "token-files"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_windows.removal_report(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_filters, op2_harmonic_packing, op3_masked_pseudo_likelihood, op4_minhash_near_duplicates, op5_unit_dedup, op6_dual_tree_topk, op7_histogram_sort_shards, op8_minhash_fingerprints, op9_token_counts, op10_byte_bpe, op11_filter_interactions, op12_byte_windows, op13_source_divergence)}
ORACLE_SQL: dict[str, str] = {
    "op6_dual_tree_topk": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * d.x[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id AND len(d.x) = len(q.x)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 5
""",
    "op11_filter_interactions": r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), m AS (
  SELECT d.part, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad,
         CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN min(d.doc_id) OVER (PARTITION BY text) < d.doc_id THEN 'E' ELSE '' END AS fails
  FROM d LEFT JOIN l ON l.doc_id = d.doc_id
), c AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, fails
), f AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f) JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS f, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)
), x AS (
  SELECT c.part, s.filter_order, s.step, s.f, c.n, c.good, c.bad, c.fails, contains(c.fails, s.f) AS own,
         c.fails <> '' AND translate(c.fails, s.before, '') <> c.fails AS gone
  FROM c, s
), r AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN own OR gone THEN 0 ELSE n END) AS kept, sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN own AND gone THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN own AND NOT gone THEN bad ELSE 0 END) AS toxic_lost
  FROM x GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM r
""",
    "op13_source_divergence": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text,
         row_number() OVER () AS row_no FROM documents
), w AS (
  SELECT lang, source, row_no, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), k AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT DISTINCT lang, source FROM d
), full_counts AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM full_counts
), q AS (
  SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)
), v AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank"
FROM (FROM pairs UNION ALL FROM terms)
QUALIFY part = 'pair' OR "rank" <= 50
""",
}
