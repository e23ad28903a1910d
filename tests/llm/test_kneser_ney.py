import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellweave.llm import kneser_ney as kn
from cellweave.llm.queries_quality import op1_quality_classifier


class Brute:
    """Interpolated modified Kneser-Ney over tuples of symbols, with the same discounts."""

    def __init__(self, texts):
        self.counts = {k: Counter() for k in range(1, kn.ORDER + 1)}
        for t in texts:
            s = self.stream(t)
            for i in range(kn.ORDER - 1, len(s)):
                self.counts[kn.ORDER][tuple(s[i - kn.ORDER + 1 : i + 1])] += 1
        for k in range(kn.ORDER - 1, 0, -1):
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += 1
        self.d = {k: kn.discounts(Counter(c.values())) for k, c in self.counts.items()}
        self.total, self.cut = ({k: Counter() for k in self.counts} for _ in range(2))
        for k, c in self.counts.items():
            for g, n in c.items():
                self.total[k][g[:-1]] += n
                self.cut[k][g[:-1]] += self.d[k][min(n, 3) - 1]

    @staticmethod
    def stream(text):
        return [kn.BEGIN] * (kn.ORDER - 1) + [ord(c) + 2 if ord(c) < 3838 else 3840 + ord(c) % 256 for c in text] + [kn.END]

    def p(self, g):
        k = len(g)
        if not k:
            return 1 / kn.SYMBOLS
        total = self.total[k][g[:-1]]
        if not total:
            return self.p(g[1:])
        n = self.counts[k][g]
        own = (n - self.d[k][min(n, 3) - 1]) / total if n else 0
        return own + self.cut[k][g[:-1]] / total * self.p(g[1:])

    def nll(self, text):
        s = self.stream(text)
        return -sum(math.log(self.p(tuple(s[i - kn.ORDER + 1 : i + 1]))) for i in range(kn.ORDER - 1, len(s)))


TRUSTED = ["the cat sat on the mat. the end", "a cat and a mat and the hat", "né dans la forêt 中", "that is that, and the rest is the rest"] * 3 + ["the cat", "x", "", None]


def test_probabilities_against_brute_force(spark):
    model = kn.Model(kn.count(spark.createDataFrame([(t,) for t in TRUSTED], "text string").repartition(3)))
    brute = Brute([t for t in TRUSTED if t])
    rows = [(i, "l", t) for i, t in enumerate([*TRUSTED, "the hat sat", "unseen ZZZ\x00 😀", "中中"])]
    docs = spark.createDataFrame(rows, "id long, lang string, text string").repartition(4)
    got = {r.id: r for r in kn.score(docs, model).collect()}
    for i, _, t in rows:
        want = brute.nll(t) if t else 0.0
        assert got[i].nll == pytest.approx(want, rel=1e-5, abs=1e-5) and got[i].n == (len(t) + 1 if t else 0)
    context = brute.stream("the c")[1:5]
    assert sum(brute.p((*context, w)) for w in range(kn.SYMBOLS)) == pytest.approx(1)


def test_defined_cases(spark):
    rows = [(1, "good text here " * 20, "en", 1), (2, "good text there " * 20, "en", 2), (3, None, "en", 3), (4, "", None, 4), (None, "good text here", None, 5), (6, "#### $$$$ %%%% " * 20, "xx", 6), (1, "good text here " * 20, "en", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    trusted = spark.createDataFrame([(1,), (2,), (1,), (None,), (99,)], "id long")
    got = {(r.id, r.lang): r for r in kn.classify(docs, trusted, holdout=0.5).collect()}
    assert len(got) == 6 and not got[3, "en"].kept and got[4, None].perplexity is None and not got[4, None].kept
    none = kn.classify(docs, trusted.limit(0)).collect()
    assert sum(r.kept for r in none) == 5 and all(r.threshold is None for r in none)
    assert kn.classify(docs.limit(0), trusted).count() == 0


def test_held_out_accuracy(spark):
    """Documents that are labelled but neither trusted nor good are rejected; good ones stay."""
    sf = "/root/testdata/sf0.01"
    scored = op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rate = {(r.quality, r.toxic): r.k for r in scored.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1, 0] > 0.98 and rate[0, 0] < 0.15 and rate[0, 1] < 0.35


def test_the_quantile_of_held_out_trusted_documents_decides(spark):
    sf = "/root/testdata/sf0.01"
    scored = op1_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    held = F.pmod(F.xxhash64(F.lit("holdout"), "doc_id"), F.lit(1000)) < 250
    for r in scored.where("quality = 1 AND toxic = 0").where(held).groupBy("lang").agg(F.avg(F.col("kept").cast("int")).alias("k"), F.count(F.lit(1)).alias("n"), F.max("threshold").alias("most"), F.max("score").alias("top")).collect():
        assert 0.98 <= r.k and r.most <= r.top + 0.001, r
    rate = {(r.quality, r.toxic): r.k for r in scored.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert rate[1, 1] < 0.93 and rate[0, 0] < 0.07
