"""One query per operator, over its whole table, and the SQL that checks it where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import (
    alignment,
    copies,
    crf,
    decontam,
    jaccard,
    lines,
    lm,
    mixing,
    passages,
    rules,
    sharding,
    spelling,
    styletree,
)
from quadrat.llm.common import table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers on this machine find the package, wherever the session was started."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The given columns of all documents."""
    importable(spark)
    return table(spark, folder, "documents").select(*columns)


def op1_site_style_tree(spark: SparkSession, folder: str) -> DataFrame:
    importable(spark)
    out = styletree.extracted(table(spark, folder, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", "n_chars")


def op2_line_crf_quality(spark: SparkSession, folder: str) -> DataFrame:
    out = crf.scored(_documents(spark, folder, "doc_id", "text"), table(spark, folder, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op3_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return lm.scored(_documents(spark, folder, "doc_id", "text"))


def op4_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return passages.found(_documents(spark, folder, "doc_id", "text"))


def op5_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.grouped(_documents(spark, folder, "doc_id", "text"))


def op6_best_fit_sharding(spark: SparkSession, folder: str) -> DataFrame:
    out = sharding.sharded(_documents(spark, folder, "doc_id", "text"), 24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    out = mixing.with_taken(_documents(spark, folder, "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_spaced_seed_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.overlaps(_documents(spark, folder, "doc_id", "text"), table(spark, folder, "benchmark"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.deduplicated(_documents(spark, folder, "doc_id", "text"), keep_text=False)
    return out.select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    out = rules.judged(_documents(spark, folder, "doc_id", "text"), table(spark, folder, "labels"))
    return out.select("doc_id", *rules.BASE, "base_failed", "kept")


def op11_content_sort(spark: SparkSession, folder: str) -> DataFrame:
    out = copies.judged(_documents(spark, folder, "doc_id", "text"))
    return out.select("doc_id", *copies.OUT)


def op12_interval_coalescing(spark: SparkSession, folder: str) -> DataFrame:
    out = alignment.aligned(_documents(spark, folder, "doc_id", "text"), keep_text=False, keep_groups=False)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_frequency_trie(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_documents(spark, folder, "doc_id", "text"))


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS key, md5(coalesce(text, '')) AS sub FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE
  ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target
  FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
p AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS passes FROM j)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(passes * size + least(greatest(budget - passes * source_size - before, 0), size) AS BIGINT) AS taken FROM p
"""

OP9_SQL = """
WITH l AS (
  SELECT row, doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT row, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
k AS (SELECT key, min(doc_id) AS least FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id <> k.least AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY row
"""

OP11_SQL = """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST) = 1 AS kept FROM d)
SELECT doc_id, keep_id, group_size, kept, sha256(norm) AS text_sha256 FROM g
"""

QUERIES = {
    f.__name__: f
    for f in (
        op1_site_style_tree, op2_line_crf_quality, op3_deleted_interpolation, op4_compact_windows, op5_ngram_jaccard_join, op6_best_fit_sharding, op7_source_mixing, op8_spaced_seed_decontamination,
        op9_line_dedup, op10_quality_rules, op11_content_sort, op12_interval_coalescing, op13_frequency_trie,
    )
}
ORACLES = {"op7_source_mixing": OP7_SQL, "op9_line_dedup": OP9_SQL, "op11_content_sort": OP11_SQL}
