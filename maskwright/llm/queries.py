"""The queries of the thirteen operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import chat, digest, html_layout, interactions, licences, ordinal, packing, pieces, pii, repair, rules, simhash, toxicity
from maskwright.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    hashed = F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return rows.select("doc_id", "n_tokens", *hashed, F.sha2("spans", 256).alias("spans_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = rules.judged(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.graded(docs, ordinal.fit(docs, ordinal.ratings(table(spark, sf_dir, "labels"))))


def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.fingerprints(table(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extracted(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/id.txt``; one that is half licence speaks for its directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.scanned(docs.withColumn("path", path), file_share=0.5)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audited(table(spark, sf_dir, "conversations"))


def op12_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digested(*chat.formatted(chat.with_smuggler(table(spark, sf_dir, "conversations"))))


#: Each order of the filters is played out over the documents themselves: no coalition, no potential.
INTERACTIONS = r"""
WITH doc AS (SELECT doc_id, coalesce(CAST(source AS VARCHAR), '') AS part, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^ 	-]+') AS w FROM doc),
known AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (SELECT part, coalesce(good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN split.doc_id > min(split.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails
  FROM split LEFT JOIN known k ON k.doc_id = split.doc_id),
cell AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
ordering AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
step AS (SELECT filter_order, s AS step, filter_order[s] AS own, filter_order[1:s - 1] AS before FROM ordering, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
played AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
    sum(CASE WHEN fails = translate(fails, before || own, '') THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(fails, own) AND fails = translate(fails, before, '') THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(fails, own) AND fails <> translate(fails, before, '') THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(fails, own) AND fails = translate(fails, before, '') THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(fails, own) AND fails = translate(fails, before, '') THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, step GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM played
"""

FUNCTIONS = (
    op1_personal_data,
    op2_toxicity,
    op3_sentencepiece,
    op4_quality_rules,
    op5_best_fit_packing,
    op6_quality_classifier,
    op7_document_fingerprints,
    op8_simhash_near_dedup,
    op9_html_extraction,
    op10_license_scan,
    op11_conversation_repair,
    op12_filter_interactions,
    op13_chat_formatting,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in FUNCTIONS}


def oracle_sql() -> dict[str, str]:
    return {"op12_filter_interactions": INTERACTIONS}
