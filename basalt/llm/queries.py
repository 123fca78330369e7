"""One query per operator over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, language, license_scan, packing, permutation_index, quality, simhash, substring_dedup, token_store, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir)).drop("broken_rules")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_documents(spark, sf_dir)).drop("detections")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir), k=2)


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return permutation_index.nearest(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_rules,
        op2_license_scan,
        op3_simhash_near_dedup,
        op4_permutation_index,
        op5_byte_bpe,
        op6_token_orc,
        op7_best_fit_packing,
        op8_toxicity,
        op9_language_id,
        op10_substring_dedup,
    )
}


def _rules_sql() -> str:
    """The threshold table as one SQL condition: no rule is broken."""
    parts = []
    for r in quality.RULES:
        outside = " OR ".join([f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None))
        parts.append(f"NOT coalesce(n_words >= {r.words} AND ({outside}), false)")
    return " AND ".join(parts)


def _quality_sql() -> str:
    stop = ", ".join("'" + w + "'" for w in sorted({w for s in quality.STOP_WORDS.values() for w in s.split()}))
    word = r"[^\x20\x09-\x0D]+"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) > 2)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (SELECT p.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
  len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)\\s*$'))) AS n_ellipsis, len(list_filter(l, lambda x: regexp_matches(x, '^\\s*[-*•‣▪·]'))) AS n_bullets,
  len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_with_letter FROM p LEFT JOIN n ON p.doc_id = n.doc_id),
x AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word, n_symbols / nullif(word_chars, 0) AS symbol_ratio, n_stop / nullif(n_words, 0) AS stop_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
  n_ellipsis / nullif(n_lines, 0) AS ellipsis_ratio, n_bullets / nullif(n_lines, 0) AS bullet_ratio, n_with_letter / nullif(n_words, 0) AS letter_ratio,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules_sql()} AS kept FROM x"""


_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
o AS (SELECT g, min(doc_id) AS first FROM g GROUP BY g),
c AS (SELECT DISTINCT g.doc_id, g.i + k AS i FROM g JOIN o ON g.g = o.g AND o.first < g.doc_id, (SELECT unnest(range(13)) AS k)),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _quality_sql(), "op10_substring_dedup": _SUBSTRING_SQL}
