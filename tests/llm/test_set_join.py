import random

import numpy as np
import pytest

from cellweave.llm import set_join as sj


def shingles(text, k=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute(docs, percent):
    sets = [shingles(t) for _, t in docs]
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def check(spark, docs, percent=85):
    frame = spark.createDataFrame([(d, t, 3, "x", b"y") for d, t in docs], "doc_id long, text string, n long, digest string, key binary").repartition(5)
    got = sj.jaccard_classes(frame, percent=percent)
    assert [f"{n}:{t}" for n, t in got.dtypes] == ["id:bigint", "n_shingles:bigint", "class_id:bigint"]
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == brute(docs, percent)
    return rows


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words[: len(words) - rng.randrange(3)]))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(300)}"
    passage = [word() for _ in range(40)]
    texts = []
    for size in (5, 12, 40, 120, 400):
        for _ in range(4):
            texts += variants(rng, [word() for _ in range(size)], 12, 2 + size // 20)
    texts += [" ".join([word() for _ in range(30)] + passage) for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(8))]) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark, monkeypatch):
    """Short and long texts at the threshold; small blocks, so that common tokens' lists are split; odd rows."""
    monkeypatch.setattr(sj, "BLOCK", 6)
    monkeypatch.setattr(sj, "FRONTIER", 500)
    docs = corpus(3)
    docs += [(7, docs[0][1]), (7, docs[1][1]), (None, docs[2][1].upper()), (None, None), (None, "lonely words of nobody here"), (None, "lonely  words\tof nobody\nhere")]
    docs += [(9000 + i, t) for i, t in enumerate([None, "", " \t", "one", "One", "one two three", "a b c d", "a b c d", "a  b c d e"])] + [(9000, "one")]
    docs += [(9100, "lorem " * 30_000 + "ipsum"), (9101, "lorem " * 20_000 + "ipsum")]
    rows = check(spark, docs)
    assert len({r[2] for r in rows}) < len(rows)


def test_empty_and_refused(spark):
    assert check(spark, []) == []
    with pytest.raises(ValueError):
        sj.jaccard_classes(spark.createDataFrame([], "doc_id long, text string"), percent=0)


def test_lists_skip_no_pair_that_can_link():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(3, 40)).astype(np.uint64)) for _ in range(80)]
    for percent in (50, 85, 100):
        bodies = []
        for i, s in enumerate(sets):
            head = np.arange(int(sj.prefix_length(len(s), percent)))
            bodies.append(sj.pack_arrays(token=s[head], salt=np.zeros(len(head), np.int32), place=head.astype(np.uint8), set=np.zeros(len(head), np.uint8), size=np.array([len(s)], np.uint8), digest=np.array([i, i], np.uint64)))
        held = sj.Lists(bodies)
        names = held.digest[:, 0]
        found = {frozenset((int(names[x]), int(names[y]))) for a, b in held.pairs(percent) for x, y in zip(a, b)}
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= percent * (len(a) + len(sets[j]) - both):
                    assert frozenset((i, j)) in found


def test_bitmaps_never_exceed_the_difference_and_forests_span():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (5, 90, 200, 400)]
    sets += [np.r_[s[: len(s) - k], np.arange(k, dtype=np.uint64)] for s in sets[:] for k in (1, 4)]
    maps = sj.Bitmaps([sj.bitmap(s) for s in sets])
    a, b = np.triu_indices(len(sets), 1)
    apart = maps.apart(a, b)
    for x, y, d in zip(a, b, apart):
        assert d <= len(np.setxor1d(sets[x], sets[y]))
    chosen = sj.nearest_forest(len(sets), a, b, apart)
    assert len(chosen) == len(sets) - 1 and set(a[chosen]) | set(b[chosen]) == set(range(len(sets)))
