"""Queries of the corpus operators, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, common, langid, mergedrop, mixing, quality, secrets, simhash, substring, toxicity, warczip
from .common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.expected_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = common.written(quality.ledger(table(spark, sf_dir, "documents")))
    base, full = quality.POLICIES[0], quality.POLICIES[-1]
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.kept(F.col("fail_bits"), base)).alias("base_failed"), quality.kept(F.col("fail_bits"), full).alias("kept"), "fail_bits",
    )


def op2b_quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy drops, alone and together, by bitwise aggregation of the stored ledger."""
    return quality.ablations(common.written(quality.ledger(table(spark, sf_dir, "documents"))))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.packaged(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mergedrop.round_trip(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op10_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.rendered)


_ALL = (
    op1_mixing, op2_quality_rules, op3_language_id, op4_toxicity, op5_warc_zip, op6_secrets, op7_merge_dropout, op8_substring_dedup, op9_simhash,
    op10_chroma, op2b_quality_ablations,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
n AS (SELECT *, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, '') AS glued,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
  list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) AS win FROM d),
o AS (SELECT *, row_number() OVER () AS r FROM n),
u AS (SELECT r, unnest(win) AS x, unnest(range(1, len(win) + 1)) AS i FROM o),
k AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM u) WHERE c > 1),
v AS (SELECT r, CAST(count(DISTINCT i + j) AS BIGINT) AS rep FROM k, (SELECT unnest(range(5)) AS j) GROUP BY r),
m AS (SELECT doc_id, n_words, CAST(length(glued) AS BIGINT) AS word_chars,
  CAST(length(glued) - length(regexp_replace(glued, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep, 0) AS n_repeat_words,
  CAST(len(lines) AS BIGINT) AS n_lines, length(glued) - length(regexp_replace(glued, '[A-Z]', '', 'g')) AS n_capitals,
  CAST(floor((length(glued) - length(replace(glued, '!!', ''))) / 2) AS BIGINT) AS n_shouts FROM o LEFT JOIN v USING (r)),
b AS (SELECT *, CAST(CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN 2 * n_capitals > word_chars THEN 16 ELSE 0 END + CASE WHEN 10 * n_shouts > n_words THEN 32 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 64 ELSE 0 END AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

ABLATIONS_SQL = f"""
WITH q AS ({OP2_SQL}),
r(bit, rule) AS (VALUES (1, 'few_words'), (2, 'repeated_windows'), (4, 'symbols'), (8, 'duplicate_lines'), (16, 'capitals'), (32, 'shouting'), (64, 'word_length')),
p(policy, mask) AS (VALUES ('2024-base', 3), ('2024-lines', 15), ('2025-full', 127))
SELECT policy, rule, count(*) AS documents, count(*) FILTER ((fail_bits & mask) = 0) AS kept, count(*) FILTER ((fail_bits & bit) <> 0) AS failed,
  count(*) FILTER ((fail_bits & mask) = bit) AS failed_alone, count(*) FILTER ((fail_bits & mask & ~bit) = 0) AS kept_without
FROM q, p, r WHERE (mask & bit) <> 0 GROUP BY policy, rule
"""

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, {_WORDS} AS w FROM documents),
u AS (SELECT r, doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM d WHERE len(w) >= 20),
x AS (SELECT r, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i+19], ' ')) ORDER BY doc_id, i) AS nth FROM u),
g AS (SELECT DISTINCT r, i + j AS p FROM x, (SELECT unnest(range(20)) AS j) WHERE nth > 1),
t AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT t.r, count(*) FILTER (g.p IS NOT NULL) AS gone, coalesce(string_agg(word, ' ' ORDER BY t.p) FILTER (g.p IS NULL), '') AS kept FROM t LEFT JOIN g ON t.r = g.r AND t.p = g.p GROUP BY t.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS one FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND one < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND one < page_id THEN one END AS refers_to FROM m
"""

ORACLES: dict[str, str] = {
    "op5_warc_zip": OP5_SQL,
    "op2_quality_rules": OP2_SQL,
    "op2b_quality_ablations": ABLATIONS_SQL,
    "op8_substring_dedup": OP8_SQL,
}
