import numpy as np

from cellweave.llm.repetition import Limits, filter_documents, find_repeats, judge, measure


def brute(text, limits=Limits()):
    words = (text or "").encode().split()
    n = len(words)

    def repeated(length):
        seen = {}
        for i in range(n - length + 1):
            seen.setdefault(tuple(words[i : i + length]), []).append(i)
        return {i for s in seen.values() if len(s) > 1 for i in s}

    longest = np.zeros(n, int)
    length = 1
    while hits := repeated(length):
        longest[list(hits)] = length
        length += 1
    three = {i + k for i in range(n) if longest[i] >= 3 for k in range(3)}
    spans = {i + k for i in range(n) if longest[i] >= limits.min_repeat for k in range(longest[i])}
    top = max([0, *(x for x in longest if x >= limits.min_repeat)])
    lines = [x for x in (text or "").encode().split(b"\n") if x.split()]
    base = n < 50 or 100 * len(three) > 50 * n
    return {
        "n_words": n, "word_chars": sum(len(w.decode()) for w in words), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(three), "base_failed": base,
        "kept": not (base or len(spans) > limits.max_covered * n or top > limits.max_repeat), "n_covered_words": len(spans), "longest_repeat": top,
    }


def texts():
    rng = np.random.default_rng(7)
    out = [None, "", " \n\t", "one", "é ü\x0bß # |", "a b c " * 40, "x " * 300, "same line\nsame line\n\nsame line \nother"]
    for i in range(60):
        words = [f"w{x}" for x in rng.integers(0, [5, 40, 3000][i % 3], rng.integers(1, 200))]
        if i % 4 == 0:
            words += words[: len(words) // 2]
        out.append(("\n" if i % 5 == 0 else " ").join(words))
    return out


def test_measure_against_brute_force():
    rows = texts()
    got = measure([None if t is None else t.encode() for t in rows])
    for i, t in enumerate(rows):
        want = brute(t)
        assert {k: got[k][i] for k in want} == want, t


def maximal(words, least):
    """Sequences found twice or more that neither side's word extends in all occurrences."""
    found = {}
    for length in range(least, len(words)):
        for i in range(len(words) - length + 1):
            found.setdefault(tuple(words[i : i + length]), []).append(i)
    out = {}
    for w, at in found.items():
        left = {words[i - 1] if i else None for i in at}
        right = {words[i + len(w)] if i + len(w) < len(words) else None for i in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out[w] = at
    return out


def test_maximal_repeats_against_brute_force():
    rng = np.random.default_rng(11)
    texts = ["x A y A x A", "a b c " * 9, "x " * 30, "one", "p q r s p q r s t p q"]
    texts += [" ".join(f"w{x}" for x in rng.integers(0, 2 + i % 4, rng.integers(2, 40))) for i in range(80)]
    codes, number, owner = {}, [], []
    for i, t in enumerate(texts):
        number += [codes.setdefault(w, len(codes)) for w in t.split()]
        owner += [i] * len(t.split())
    for least in (1, 3):
        got = find_repeats(np.array(number), np.array(owner), least)
        spans, at = dict(zip(got.starts.tolist(), got.lengths.tolist())), 0
        for i, t in enumerate(texts):
            want = maximal(t.split(), least)
            assert sorted(got.maximal[got.maximal_owner == i].tolist()) == sorted(map(len, want)), t
            starts = {}
            for w, places in want.items():
                for p in places:
                    starts[p] = max(starts.get(p, 0), len(w))
            n = len(t.split())
            assert {p - at: k for p, k in spans.items() if at <= p < at + n} == starts, t
            at += n


def test_long_repetitive_text_needs_linear_memory():
    import tracemalloc

    tracemalloc.start()
    got = measure([b"x " * 300_000])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["n_covered_words"][0] == 300_000 and got["longest_repeat"][0] == 299_999 and got["n_maximal_repeats"][0] == 299_992
    assert peak < 300_000 * 500


def test_query_and_filter(spark):
    rows = [(i, t, "c", i) for i, t in enumerate(texts())] + [(None, "n " * 60, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int")
    got = {r.id: r for r in judge(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[i].kept == brute(t)["kept"] for i, t, *_ in rows)
    kept = filter_documents(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, t, *_ in rows if brute(t)["kept"])
    assert judge(frame.limit(0)).count() == 0 and filter_documents(frame.limit(0)).count() == 0
