"""Connected components of a distributed edge list, by alternating stars.

Each round joins the edges with per-node minima that were pre-aggregated
before the shuffle, so a hub's edges are never gathered in one group; Spark
splits the hub's side of the join.  Rounds are cut by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._base import saved


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star operation on (u, v) with u > v; `both`: neighbours on either side count."""
    sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sides.join(least, "u")
    if both:
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge; root is the component's smallest node.

    Null ends and self-loops are ignored; no edges give an empty frame.
    """
    held = saved(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    while True:
        held = saved(_star(_star(held, True), False))
        mark = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    nodes = held.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
