"""op12: versions of the sessions of `conversations`, with late batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.sessions import merge_sessions


def conversation_events(conversations: DataFrame) -> DataFrame:
    """(user, time, batch, h) of each turn."""
    rows = conversations.where("turn IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"))
    hashed = rows.withColumns({"c": F.expr("crc32(cast(cast(conv AS string) AS binary))"), "h": F.expr("crc32(cast(concat(conv, ':', turn) AS binary))")})
    timed = hashed.withColumns({"user": F.expr("2 * ((conv - pmod(conv, 8L)) div 8) + c % 2"), "time": F.expr("(c div 2) % 7200 + 300 * turn + h % 600"), "g": F.expr("h div 600")})
    return timed.select("user", "time", F.expr("(time - pmod(time, 1800L)) div 1800 + if(g % 3 = 0, g % 4, 0)").alias("batch"), "h")


def op12_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = conversation_events(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    found = merge_sessions(events, gap=240, value="h")
    return found.select("user", "batch", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "n_events", "n_new", "n_retracted", F.col("total").alias("h_sum"), "retracted_batch", F.col("retracted_start").alias("retracted_start_s"))


QUERIES = {"op12_late_sessions": op12_late_sessions}

# The state after each batch is made anew from all events up to it; CRC-32 comes from its polynomial.
ORACLE = {
    "op12_late_sessions": r"""
WITH t AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS crc
  FROM range(256) r(n)
), a AS MATERIALIZED (
  SELECT conv_id::BIGINT AS conv, turn::BIGINT AS turn FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL
), w AS (
  SELECT conv::VARCHAR AS s FROM a UNION SELECT conv || ':' || turn FROM a
), x AS MATERIALIZED (
  SELECT s, xor(list_reduce(list_transform(range(length(s)), lambda i: ascii(s[i + 1])::BIGINT),
                            lambda r, b: xor(r >> 8, crc[xor(r & 255, b) + 1]), 4294967295), 4294967295) AS h
  FROM w, t
), m AS (
  SELECT conv, turn, c.h AS c, h.h AS h, h.h // 600 AS g FROM a JOIN x c ON c.s = conv::VARCHAR JOIN x h ON h.s = conv || ':' || turn
), n AS (
  SELECT 2 * floor(conv / 8)::BIGINT + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS s, g, h FROM m
), e AS MATERIALIZED (
  SELECT u, s, h, floor(s / 1800)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch FROM n
), p AS (
  SELECT b.u, b.batch AS b, e.s, e.batch, e.h FROM (SELECT DISTINCT u, batch FROM e) b JOIN e ON e.u = b.u AND e.batch <= b.batch
), q AS (
  SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY u, b ORDER BY s) <= 240 THEN 0 ELSE 1 END AS cut FROM p
), z AS (
  SELECT *, sum(cut) OVER (PARTITION BY u, b ORDER BY s) AS k FROM q
), v AS MATERIALIZED (
  SELECT u, b AS batch, min(s) AS start_s, max(s) AS end_s, count(*) AS n_events, count(*) FILTER (batch = b) AS n_new, sum(h) AS h_sum
  FROM z GROUP BY u, b, k HAVING count(*) FILTER (batch = b) > 0
), r AS MATERIALIZED (
  SELECT v.u, v.batch, v.start_s, min(w.batch) AS retracted_batch, arg_min(w.start_s, w.batch) AS retracted_start_s
  FROM v JOIN v w ON w.u = v.u AND w.batch > v.batch AND w.start_s <= v.start_s AND w.end_s >= v.end_s GROUP BY ALL
), l AS (
  SELECT u, retracted_batch AS batch, retracted_start_s AS start_s, count(*) AS n_retracted FROM r GROUP BY ALL
)
SELECT v.u::BIGINT AS "user", v.batch::BIGINT AS batch, v.start_s::BIGINT AS start_s, v.end_s::BIGINT AS end_s, n_events::BIGINT AS n_events, n_new::BIGINT AS n_new,
       coalesce(n_retracted, 0)::BIGINT AS n_retracted, h_sum::BIGINT AS h_sum, retracted_batch::BIGINT AS retracted_batch, retracted_start_s::BIGINT AS retracted_start_s
FROM v LEFT JOIN r USING (u, batch, start_s) LEFT JOIN l USING (u, batch, start_s)
"""
}
