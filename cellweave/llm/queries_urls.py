"""op5: judge the urls of `pages` by rules and a cascade of listed hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.url_filter import host, judge

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed: hosts of which more than half the pages carry a query string (link farms and trackers)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    tracked = F.coalesce(F.contains("url", F.lit("?")), F.lit(False)).cast("int")
    listed = pages.groupBy(host(F.col("url")).alias("host")).agg(F.sum(tracked).alias("t"), F.count(F.lit(1)).alias("n")).where("2 * t > n").select("host")
    return judge(pages, RULES, listed).withColumnRenamed("id", "page_id")


QUERIES = {"op5_url_filter": op5_url_filter}
ORACLE = {
    "op5_url_filter": r"""
WITH p AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), l AS (
  SELECT host FROM p WHERE host <> '' GROUP BY host HAVING 2 * sum(coalesce(contains(url, '?'), false)::INT) > count(*)
), r AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS v(what, h, pre)
), f AS (
  SELECT page_id, arg_max(h || pre, length(h || pre)) AS rule, arg_max(what, length(h || pre)) AS what
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pre) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.what, CASE WHEN l.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id) LEFT JOIN l ON p.host = l.host
"""
}
