"""op2: repeated 20-word windows of `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.substring_dedup import remove_repeated_windows


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}

# Words by regexp, windows as lists; a window's first start is the least (doc_id, position).
ORACLE = {
    "op2_substring_dedup": r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS p, words FROM w WHERE len(words) >= 20
), h AS (
  SELECT doc_id, p, md5(array_to_string(words[p : p + 19], ' ')) AS k FROM s
), f AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS n FROM h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM f WHERE n > 1
), g AS (
  SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda x, i: qs IS NULL OR NOT list_contains(qs, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
}
