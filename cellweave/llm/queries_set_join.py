"""op13: documents of `documents` whose shingle sets are similar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.set_join import jaccard_classes


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    classed = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return classed.select(F.col("id").alias("doc_id"), "n_shingles", F.col("class_id").alias("component_id"))


QUERIES = {"op13_jaccard_join": op13_jaccard_join}

# Links from the common shingles of every pair of different sets; components as the transitive closure of links.
ORACLE = {
    "op13_jaccard_join": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle
  FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n, md5(string_agg(md5(shingle), '' ORDER BY md5(shingle))) AS same FROM s GROUP BY doc_id
), f AS MATERIALIZED (
  SELECT same, min(doc_id) AS doc_id, any_value(n) AS n FROM n GROUP BY same
), o AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM (SELECT * FROM s WHERE doc_id IN (SELECT doc_id FROM f)) a JOIN (SELECT * FROM s WHERE doc_id IN (SELECT doc_id FROM f)) b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM o JOIN f x ON x.doc_id = a JOIN f y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r(a, b) AS (
  SELECT doc_id, doc_id FROM f UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN f USING (same) LEFT JOIN c ON c.a = f.doc_id
"""
}
