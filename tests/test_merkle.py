import random

import pytest
from pyspark.sql import functions as F

from cellweave.operators import merkle


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, g string, v double").repartition(4)


def test_differences_against_a_plain_comparison(spark):
    rng = random.Random(0)
    one = [(k, f"g{k % 7}", rng.random()) for k in range(500)] + [(None, None, 1.0), (7, "g0", 5.0), (7, "g0", 5.0)]
    two = [r for r in one if r[0] is None or r[0] % 97] + [(1000, "g6", None)]
    two[3] = (*two[3][:2], None)
    two.append((7, "g0", 5.0))
    keys = lambda rows: {(k, g): sorted((str(r) for r in rows if r[:2] == (k, g))) for k, g, _ in rows}
    a, b = keys(one), keys(two)
    want = {k: "removed" if k not in b else "added" if k not in a else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}
    got = merkle.differences(frame(spark, one), frame(spark, two), ["k", "g"], depth=2)
    assert {(r.k, r.g): r.kind for r in got.collect()} == want and {"removed", "added", "changed"} <= set(want.values())


def test_trees_and_their_comparison(spark):
    rows = [(k, "g", float(k)) for k in range(2000)]
    one = merkle.tree(frame(spark, rows), ["k"], 3)
    levels = {r.level: (r["count"], r.n) for r in one.groupBy("level").agg(F.count("*").alias("count"), F.sum("n").alias("n")).collect()}
    assert levels[0] == (1, 2000) and levels[1] == (16, 2000) and levels[2] == (256, 2000) and levels[3][1] == 2000
    again = merkle.tree(frame(spark, rows[::-1]).select("v", "g", "k"), ["k"], 3)
    assert merkle.differing_leaves(one, again, 3).count() == 0
    changed = merkle.tree(frame(spark, [(k, g, -v if k in (5, 900) else v) for k, g, v in rows]), ["k"], 3)
    leaves = {r.node for r in merkle.differing_leaves(one, changed, 3).collect()}
    assert leaves == {r.n for r in frame(spark, [(5, "g", 0.0), (900, "g", 0.0)]).select(merkle.leaf(["k"], 3).alias("n")).collect()}
    empty = merkle.tree(frame(spark, []), ["k"], 3)
    assert empty.count() == 0 and merkle.differing_leaves(one, empty, 3).count() == levels[3][0]
    with pytest.raises(ValueError):
        merkle.tree(one, ["node"], 0)
    with pytest.raises(ValueError):
        merkle.differences(frame(spark, rows), one, ["k"])
