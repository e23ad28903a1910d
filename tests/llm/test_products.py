import math

import numpy as np
from pyspark.sql import functions as F

from cellweave.llm import top_products as tp


def brute(rows, k, query):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in ok if i is not None and query(i)}:
        for vec in {tuple(v) for i, v in ok if i == q}:
            scored = [(-sum(a * b for a, b in zip(vec, v)), i is None, i or 0) for i, v in ok if i != q]
            out += [(q, r + 1, None if n else i, -s) for r, (s, n, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def check(spark, rows, k=5, query=lambda i: i % 5 == 0):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, score int, id int").repartition(3)
    got = tp.top_products(frame, k, is_query=F.col("id") % 5 == 0)
    assert [f"{n}:{t}" for n, t in got.dtypes] == ["query_id:bigint", "rank:int", "id:bigint", "score:bigint"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, k, query)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tp, "QUERY_BLOCK", 23)
    monkeypatch.setattr(tp, "SAMPLE", 50)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 8)) @ np.diag([5, 3, 1, 1, 0.5, 0.2, 0.1, 0.1])
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, [0.5] * 8) for i in range(80)]
    rows += [(2000, None), (2005, [1.0, None] + [0.0] * 6), (2010, [math.nan] * 8), (2015, [math.inf] * 8), (2020, []), (2025, [1.0]), (None, [0.5] * 8), (2030, [0.0] * 8), (10, [-1.0] * 8), (10, [0.25] * 8), (10, [0.25] * 8)]
    check(spark, rows)


def test_large_components_few_rows_and_empty(spark):
    check(spark, [(0, [7e6, -3.0]), (5, [2e6, 1e3]), (7, [-7e6, 4.0]), (10, [1e-9, 0.0])])
    check(spark, [(0, [1.0])])
    assert tp.top_products(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
