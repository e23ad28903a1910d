import hashlib

import numpy as np

from cellweave.llm import substring_dedup as sd


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for i in range(150):
        words = [f"v{x}" for x in rng.integers(0, 400, rng.integers(0, 120))]
        if i % 3 == 0:
            a = rng.integers(0, 40)
            words[len(words) // 2 : len(words) // 2] = shared[a : a + rng.integers(15, 30)]
        rows.append((int(rng.permutation(1000)[0]) * 1000 + i, "  ".join(words)))
    loop = " ".join(["x y z"] * 40)
    rows += [(5, loop), (6, None), (7, ""), (8, rows[0][1]), (None, rows[3][1]), (9, rows[1][1].replace("  ", "\n")), (10, "tail " * 19)]
    frame = spark.createDataFrame([(d, t, b"q") for d, t in rows], "doc_id long, text string, body binary").repartition(5)
    got = sd.remove_repeated_windows(frame).collect()
    want = sd.brute_force(rows)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got), key=key) == sorted(want, key=key)
    assert sd.remove_repeated_windows(frame.limit(0)).count() == 0


def test_repeated_rows_keep_one_copy(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text)] * 5 + [(2, text), (None, text)], "doc_id long, text string").repartition(3)
    got = sorted((r.id is None, r.id, r.n_removed) for r in sd.remove_repeated_windows(frame).collect())
    assert [g[2] for g in got] == [0, 40, 40, 40, 40, 40, 40] and got[0][1] == 1


def test_very_long_text(spark):
    text = " ".join(str(i % 5000) for i in range(200_000))
    got = sd.remove_repeated_windows(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n_words, got.n_removed) == (200_000, 195_000)
