import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cellweave.llm.pii import Pseudonyms
from cellweave.llm.queries_pii import KEY
from cellweave.llm.repetition import measure

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, copies int"


def rows():
    rng = np.random.default_rng(9)
    out = []
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, 4000, rng.integers(60, 200))]
        out.append((i, " ".join(words), "en", ["a", "b", None][i % 3], 1, "x", i))
        if i % 6 == 0:
            words[5] = "changed"
            out.append((100 + i, " ".join(words), "en", "a", 1, None, 0))
    out += [(300, None, None, None, None, None, None), (301, "", "", "", 0, "", 0), (302, "again and again " * 60, "en", "a", 1, "", 0), (None, out[1][1] + " mail me.7@example.com", None, "b", 1, "", 0), (2, out[3][1], "en", "a", 1, "", 0)]
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.createDataFrame(rows(), SCHEMA).repartition(3), []
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("p") / name)
        f(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_quality_stage(stages):
    kept = measure([None if r[1] is None else r[1].encode() for r in rows()])["kept"]
    want = sorted(str(r[0]) for r, k in zip(rows(), kept) if k)
    assert sorted(str(r.doc_id) for r in stages[0].collect()) == want


def test_near_duplicate_stage_against_brute_force(stages):
    docs = [(r.doc_id, r.text) for r in stages[0].collect()]

    def shingles(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    first = lambda ids: min((d for d in ids if d is not None), default=None)
    want = [first([d for (d, _), r in zip(docs, root) if r == g]) for g in set(root)]
    assert sorted(map(str, (r.doc_id for r in stages[1].collect()))) == sorted(map(str, want))


def test_columns_personal_data_and_mixture(stages):
    for docs in stages[:-1]:
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    tool = Pseudonyms(KEY)
    want = sorted(str((r.doc_id, tool.replace(r.text))) for r in stages[1].collect())
    assert sorted(str((r.doc_id, r.text)) for r in stages[2].collect()) == want
    copies = {r.doc_id: r["count"] for r in stages[3].groupBy("doc_id").count().collect()}
    assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in stages[2].collect()}


def test_packing_covers_the_mixture(stages):
    spark = stages[0].sparkSession
    total = stages[4].agg(F.sum("length")).first()[0]
    assert total == stages[4].where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert stages[4].where("start = 0").count() == stages[3].count()
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in cp.STAGES:
        docs = f(spark, docs, "")
    assert docs.count() == 0
