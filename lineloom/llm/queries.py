"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineloom.llm import chat, exact_dedup, licenses, media, mixing, quality, sharding, simhash, toxicity, unigram
from lineloom.llm.common import documents


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(documents(spark, sf_dir), path=f"{sf_dir}/documents.parquet")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_rows(documents(spark, sf_dir))


def op3_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(documents(spark, sf_dir))


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_rows(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_rows(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_dedup(documents(spark, sf_dir))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.piece_rows(documents(spark, sf_dir))


def op9_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(chat.conversation_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")), chat.TOOLS)


def op10_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_license_scan, op3_entropy_mixing, op4_rule_quality, op5_crf_toxicity, op6_simhash_near_dedup, op7_vector_sharding, op8_unigram_pieces, op9_tool_chat, op10_iso_media, pipeline)
}



def _license_sql() -> str:
    """The licence scan over the same templates, with grams compared as lists of words."""
    values = ", ".join(f"({t['tid']}, '{t['kind']}', '{t['label']}', {t['k']}, {t['words']!r})" for t in licenses.templates())
    return rf"""
WITH t(tid, kind, label, k, words) AS (VALUES {values}),
g AS (SELECT tid, kind, label, k, n_grams, spot, words[spot + 1 : spot + k] AS gram FROM (SELECT *, len(words) - k + 1 AS n_grams, UNNEST(range(0, len(words) - k + 1)) AS spot FROM t)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT r, pos, w[pos + 1 : pos + {licenses.PHRASE_K}] AS short, w[pos + 1 : pos + {licenses.NOTICE_K}] AS long FROM (SELECT r, w, UNNEST(range(0, len(w))) AS pos FROM d)),
v AS (SELECT r, pos, g.* FROM p JOIN g ON short = gram WHERE k = {licenses.PHRASE_K} UNION ALL SELECT r, pos, g.* FROM p JOIN g ON long = gram WHERE k = {licenses.NOTICE_K}),
a AS (SELECT r, tid, kind, label, k, n_grams, pos - spot AS diagonal, list(DISTINCT spot) AS ats, min(pos) AS first, max(pos) AS last FROM v GROUP BY ALL),
b AS (SELECT *, CASE WHEN diagonal - lag(diagonal, 1, -1073741824) OVER x > CASE kind WHEN 'notice' THEN (n_grams + k - 1) // {licenses.NEAR_PART} ELSE 0 END THEN 1 ELSE 0 END AS starts FROM a WINDOW x AS (PARTITION BY r, tid ORDER BY diagonal)),
c AS (SELECT *, sum(starts) OVER (PARTITION BY r, tid ORDER BY diagonal) AS span FROM b),
e AS (SELECT r, tid, kind, label, n_grams, span, len(list_distinct(flatten(list(ats)))) / n_grams AS similarity, min(first) AS first FROM c GROUP BY r, tid, kind, label, n_grams, span),
f AS (SELECT * FROM e WHERE similarity >= CASE kind WHEN 'notice' THEN {licenses.MIN_SIMILARITY} ELSE 1.0 END),
h AS (SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(first) FILTER (kind = 'base') AS first_word, max(first) FILTER (kind = 'base') AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(similarity) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN h USING (r)
"""


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": _license_sql(),
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
    "op9_tool_chat": """
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS content, length(coalesce(text, '')) AS n FROM conversations),
j AS (
  SELECT *, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE role WHEN 'user' THEN conv_id || ':' || CASE WHEN turn % 6 >= 4 THEN turn - 2 ELSE turn END WHEN 'assistant' THEN conv_id || ':' || CASE WHEN n % 3 = 0 THEN turn + 1 ELSE turn - 1 END END AS call_id,
    CASE WHEN role <> 'user' THEN NULL WHEN n % 16 = 3 THEN 'nothing' WHEN n % 4 = 1 THEN 'search' WHEN n % 4 = 2 THEN 'count' ELSE 'reply' END AS name
  FROM c),
a AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, call_id, kind ORDER BY turn, name, content) AS nth,
    CASE WHEN kind = 'call' THEN CASE name WHEN 'nothing' THEN false WHEN 'search' THEN n % 5 <> 0 WHEN 'count' THEN n % 10 <> 2 ELSE n % 12 <> 0 AND n % 20 <> 4 END END AS valid,
    CASE name WHEN 'search' THEN '{"limit":' || CASE WHEN n % 5 = 0 THEN '"' || n % 7 || '"' ELSE (n % 7)::VARCHAR END || ',"query":' || to_json(content)::VARCHAR || '}'
      WHEN 'count' THEN CASE WHEN n % 10 = 2 THEN '{}' ELSE '{"chars":' || n || '.5}' END
      ELSE CASE WHEN n % 20 = 4 THEN '' ELSE '{"chars":' || n || CASE WHEN n % 12 = 0 THEN ',"more":true' ELSE '' END || ',"text":' || to_json(content)::VARCHAR || ',"turn":' || turn || '}' END END AS arguments
  FROM j),
s AS (SELECT conv_id, call_id, min(turn) FILTER (kind = 'call') AS asked, count(*) FILTER (kind = 'result') AS answers FROM a WHERE call_id IS NOT NULL GROUP BY ALL),
l AS (
  SELECT a.*, CASE kind WHEN 'call' THEN CASE WHEN nth > 1 THEN 'repeated' WHEN answers > 0 THEN 'linked' ELSE 'open' END WHEN 'result' THEN CASE WHEN asked IS NULL THEN 'orphan' ELSE 'linked' END ELSE 'none' END AS link,
    CASE WHEN kind = 'result' AND asked > turn THEN asked ELSE turn END AS order_turn, CASE kind WHEN 'result' THEN 1 ELSE 0 END::INT AS order_rank
  FROM a LEFT JOIN s USING (conv_id, call_id))
SELECT conv_id, turn, role, kind, link, call_id, order_turn, order_rank, row_number() OVER (PARTITION BY conv_id ORDER BY order_turn, order_rank, turn, kind, role, content) - 1 AS position, valid,
  '{"content":' || to_json(content)::VARCHAR || ',"role":' || to_json(role)::VARCHAR
    || CASE kind WHEN 'call' THEN ',"tool_call":{"arguments":' || to_json(arguments)::VARCHAR || ',"id":' || to_json(call_id)::VARCHAR || ',"name":' || to_json(name)::VARCHAR || '}'
       WHEN 'result' THEN ',"tool_call_id":' || to_json(call_id)::VARCHAR ELSE '' END || '}' AS line
FROM l
""",
}
