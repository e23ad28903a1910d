"""Digest trees over ranges of hashed keys: where two tables differ, without comparing what is equal.

A row belongs to the leaf that the first bits of its key's hash name.  One
aggregation gives each leaf a digest of its rows as a multiset (sums of row
hashes, so nothing is sorted or collected); each level above digests `FANOUT`
children.  Two trees are compared from the root down, and only the children of
nodes that differ are looked at, so equal parts cost nothing.  A stored tree
stands for its table: a later run finds the changed ranges from it alone, and
rows are joined only inside these.

Null keys are keys like any other; repeated rows count; the trees of two tables
are comparable if keys, columns and depth are the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.sinks import checkpointed

#: Bits of the node number that a level adds, and the children of a node.
BITS = 4
FANOUT = 1 << BITS


def _hash(columns: list[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)), {"ignoreNullFields": "false"}), 256)


def leaf(keys: list[str], depth: int) -> Column:
    """The leaf of a row: the first `depth` hexadecimal digits of its key's hash."""
    return F.conv(F.substring(_hash(keys), 1, depth), 16, 10).cast("long")


def tree(rows: DataFrame, keys: list[str], depth: int = 4, columns: list[str] | None = None) -> DataFrame:
    """(level, node, digest, n): level 0 is the root, level `depth` the leaves; nodes without rows are left out.

    `columns` (all by default) are what a row's digest covers.
    """
    if not 1 <= depth <= 12:
        raise ValueError("depth must be between 1 and 12")
    named = rows.select(leaf(keys, depth).alias("node"), _hash(sorted(columns or rows.columns)).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(4)]
    counted = named.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *parts)
    level = checkpointed(counted.select("node", F.sha2(F.concat_ws(":", "n", "p0", "p1", "p2", "p3"), 256).alias("digest"), "n"))
    out = level.withColumn("level", F.lit(depth))
    for d in range(depth - 1, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # at most FANOUT
        up = level.withColumn("parent", F.floor(F.col("node") / FANOUT).cast("long")).groupBy("parent")
        level = up.agg(F.sha2(F.to_json(children), 256).alias("digest"), F.sum("n").alias("n")).select(F.col("parent").alias("node"), "digest", "n")
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return out.select("level", "node", "digest", "n")


def differing_leaves(one: DataFrame, two: DataFrame, depth: int = 4) -> DataFrame:
    """(node) of the leaves whose digests differ, found from the root down."""
    suspects: DataFrame | None = None
    for d in range(depth + 1):
        a, b = (t.where(F.col("level") == d).select("node", F.col("digest").alias(name)) for t, name in ((one, "a"), (two, "b")))
        if suspects is not None:
            below = suspects.select(F.explode(F.sequence(F.col("node") * FANOUT, F.col("node") * FANOUT + FANOUT - 1)).alias("node"))
            a, b = a.join(below, "node", "left_semi"), b.join(below, "node", "left_semi")
        apart = a.join(b, "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        suspects = checkpointed(apart)
        if suspects.isEmpty():
            break
    return suspects


def differences(one: DataFrame, two: DataFrame, keys: list[str], depth: int = 4) -> DataFrame:
    """(keys, kind): keys whose rows are `removed`, `added` or `changed` from one table to the other.

    Only rows of leaves that differ are joined.  Rows that repeat a key are compared as a multiset.
    """
    if sorted(one.columns) != sorted(two.columns):
        raise ValueError("the tables have different columns")
    leaves = differing_leaves(tree(one, keys, depth), tree(two, keys, depth), depth)

    def inside(rows: DataFrame, side: str) -> DataFrame:
        hashed = rows.withColumn("__node", leaf(keys, depth)).join(leaves.withColumnRenamed("node", "__node"), "__node", "left_semi")
        parts = [F.sum(F.conv(F.substring(_hash(sorted(rows.columns)), 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")) for k in range(4)]
        return hashed.groupBy(*keys).agg(F.concat_ws(":", F.count(F.lit(1)), *parts).alias(side))

    both = inside(one, "__one").withColumn("__two", F.lit(None).cast("string")).unionByName(inside(two, "__two").withColumn("__one", F.lit(None).cast("string")))
    met = both.groupBy(*keys).agg(F.max("__one").alias("__one"), F.max("__two").alias("__two")).where(~F.col("__one").eqNullSafe(F.col("__two")))
    return met.select(*keys, F.when(F.col("__two").isNull(), "removed").when(F.col("__one").isNull(), "added").otherwise("changed").alias("kind"))
