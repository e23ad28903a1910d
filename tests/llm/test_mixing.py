import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm.mixing import balance, materialise, mix, round_to_copies, targets_for


def test_targets_share_the_excess():
    assert targets_for([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert targets_for([10, 100, 100], [5, 2, 1]) == [30.0, 120.0, 60.0]
    assert targets_for([1, 1, 1000], [5, 2, 1]) == [3.0, 3.0, 996.0]
    assert targets_for([0, 10], [5, 2]) == [0.0, 10.0] and targets_for([], []) == []


def test_rounding_keeps_to_the_share():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(0, 500, 300))[::-1]
    for rate in (0.05, 0.7, 1.0, 2.4, 3.0):
        copies = round_to_copies(size, np.full(300, rate), 3)
        assert copies.max() <= 3 and copies.min() >= 0
        assert abs((copies * size).sum() - rate * size.sum()) <= 10


def frame(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(1, 300)), ["a", "b", "é", None, "hot", "hot", "hot"][i % 7], i) for i in range(900)]
    rows += [(None, "null id", "b", 0), (2000, None, "a", 0), (2001, "", "onlyempty", 0), (2002, "same", "b", 0), (2002, "same", "b", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, rate int")


def test_mix_meets_targets_and_reruns_agree(spark):
    docs = frame(spark)
    got = mix(docs).collect()
    assert len(got) == docs.count()
    sizes, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r.copies <= 3
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
        target[r.source] = r.target
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = targets_for([sizes[s] for s in order], [[5, 2, 1][i % 3] for i in range(len(order))])
    for s, t in zip(order, want):
        assert target[s] == pytest.approx(t) and abs(taken[s] - t) <= max(5, 0.002 * t)
    key = lambda rows: sorted((str(r.id), r.size, r.copies) for r in rows)
    assert key(got) == key(mix(docs.repartition(7)).collect())
    assert mix(docs.limit(0)).count() == 0
    mixed = mix(docs, digest=True)
    out = materialise(docs, mixed)
    assert out.columns == docs.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]


def plain_multiplier(sizes, target, most=3.0):
    """The dual of one source by bisection."""
    lo, hi = -100.0, math.log(most)
    for _ in range(300):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(s * math.exp(min(s * mid, math.log(most))) for s in sizes) < target else (lo, mid)
    return (lo + hi) / 2


@pytest.mark.parametrize("share", [0.001, 0.3, 1.0, 1.7, 2.9, 2.9999])
def test_newton_against_bisection(spark, share):
    rng = np.random.default_rng(4)
    sizes = {"a": [int(x) for x in np.exp(rng.normal(5, 1.5, 300)) + 1], "b": [7] * 50, None: [1, 20_000]}
    table = spark.createDataFrame([(s, x) for s, xs in sizes.items() for x in xs], "source string, mass long")
    targets = {s: share * sum(xs) for s, xs in sizes.items()}
    alpha, _ = balance(table, targets)
    for s, xs in sizes.items():
        got = sum(x * math.exp(min(x * alpha[s], math.log(3))) for x in xs)
        assert got == pytest.approx(targets[s], rel=1e-5), s
        assert alpha[s] == pytest.approx(plain_multiplier(xs, targets[s]), rel=1e-3, abs=1e-7), s
    alpha, _ = balance(table, {"a": 0.0, "b": 3.0 * 350, None: 5.0})
    assert alpha["a"] == -math.inf and 7 * alpha["b"] >= math.log(3)


def test_newton_meets_moments(spark):
    rng = np.random.default_rng(3)
    rows = [(["a", "b"][i % 2], int(rng.integers(1, 50)), float(rng.random())) for i in range(400)]
    table = spark.createDataFrame(rows, "source string, mass long, x double")
    alpha, beta = balance(table, {"a": 9000.0, "b": 3000.0}, {"x": 12000 * 0.62})
    rate = lambda s, m, x: min(3.0, math.exp(m * (alpha[s] + beta["x"] * x)))
    assert sum(m * rate(s, m, x) for s, m, x in rows if s == "a") == pytest.approx(9000, rel=1e-6)
    assert sum(m * rate(s, m, x) for s, m, x in rows if s == "b") == pytest.approx(3000, rel=1e-6)
    assert sum(m * x * rate(s, m, x) for s, m, x in rows) == pytest.approx(12000 * 0.62, rel=1e-6)


def test_equal_rows_are_dealt_to_many_groups(spark, monkeypatch):
    from cellweave.llm import mixing

    monkeypatch.setattr(mixing, "GROUP", 10)
    rows = [(None, "same words here", "a")] * 500 + [(1, "one two", "a")] * 300 + [(i, "w " * 5, "b") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == len(rows)
    for s in "ab":
        assert sum(r.copies * r.size for r in got if r.source == s) == pytest.approx(next(r.target for r in got if r.source == s), rel=0.05)
    assert sorted(map(str, got)) == sorted(map(str, mix(docs.repartition(5)).collect()))


def test_materialised_words_are_the_words_that_were_asked(spark):
    """Ids that repeat over sources, texts and rows, and many rows without an id."""
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 40)), "w " * int(rng.integers(1, 9)), "ab"[int(rng.integers(0, 9)) > 0], i) for i in range(400)]
    rows += [(None, "x y z", "a", i) for i in range(150)] + [(None, f"x y {i}", "b", i) for i in range(150)] + [(None, "x y z", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int").repartition(5)
    mixed = mix(docs, digest=True)
    words = F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")
    asked = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n")).collect() if r.n}
    made = materialise(docs, mixed)
    assert {r.source: r.n for r in made.groupBy("source").agg(words).collect()} == asked
    assert made.groupBy("doc_id", "text", "source", "copies").count().agg(F.max("count")).first()[0] <= 3
