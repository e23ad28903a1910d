"""URL filters: host and path rules, then a block list of hosts in a Bloom filter cascade.

Defined results: a null url, or one without ://, has an empty host and path,
fits no rule and is never listed (so it is allowed); repeated urls and rows are
judged alike; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm import bloom_cascade

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host_: Column, path_: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; rules are (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict): the rule's verdict, else block for hosts in `listed` (column `host`).

    The cascade's universe is every host of `pages`.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"))
    parted = rows.select("id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    names = listed.select(F.col("host").alias("key")).where("key <> ''").distinct().withColumn("listed", F.lit(True))
    universe = parted.select(F.col("host").alias("key")).distinct().join(names, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))
    cascades, shards = bloom_cascade.build(universe)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    marked = bloom_cascade.mark(parted, "host", cascades, shards, "in_list")
    return marked.select("id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("in_list"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
