"""op11: draw the tenth of `documents` that resembles `benchmark` most, with noise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.resampling import resample


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {"op11_importance_resampling": op11_importance_resampling}

# CRC-32 is built from its polynomial, by a table of 256 entries, over the UTF-8 bytes of each different word.
ORACLE = {
    "op11_importance_resampling": r"""
WITH t AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc
  FROM range(256) r(n)
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), b AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM benchmark
), f AS MATERIALIZED (
  SELECT k, unnest(words) AS w FROM d
), v AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_transform(range(octet_length(encode(w))), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT),
                            lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT w FROM f UNION SELECT w FROM b), t
), s AS (
  SELECT bucket, count(*) AS n FROM f JOIN v USING (w) GROUP BY bucket
), g AS (
  SELECT bucket, count(*) AS n FROM b JOIN v USING (w) GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT r.bucket, floor(1000 * ln(((coalesce(g.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE)
                   / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM b) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(10000) r(bucket) LEFT JOIN s USING (bucket) LEFT JOIN g USING (bucket)
), w AS (
  SELECT k, sum(gain)::BIGINT AS weight FROM f JOIN v USING (w) JOIN gain USING (bucket) GROUP BY k
), h AS (
  SELECT d.doc_id, len(d.words) AS n_features, coalesce(w.weight, 0) AS weight,
         (('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE AS u
  FROM d LEFT JOIN w USING (k)
), x AS (
  SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM h
), r AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM x
)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END::BIGINT AS rank
FROM r
"""
}
