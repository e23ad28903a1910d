import hashlib
import math
import re
import zlib
from collections import Counter

from cellweave.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = WORD.findall(lower)
    return found, [" ".join(found[i : i + n]) for n in range(1, most + 1) for i in range(len(found) - n + 1)]


def brute(docs, target, most, buckets, least, percent, seed):
    number = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(number(f) for _, t in docs for f in features(t, most)[1])
    t = Counter(number(f) for x in target for f in features(x, most)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        found, grams = features(x, most)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[number(f)] for f in grams)
        rows.append([i, len(found), len(grams), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(str, rows))


def check(spark, docs, target, most=1, buckets=50, least=3, percent=40, seed=7):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, words string, bucket int").repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = rs.resample(frame, wanted, most=most, buckets=buckets, least_words=least, percent=percent, seed=seed)
    assert [f"{n}:{t}" for n, t in got.dtypes] == ["id:bigint", "n_words:bigint", "n_features:bigint", "weight:bigint", "score:bigint", "rank:bigint"]
    rows = [list(r) for r in got.collect()]
    assert sorted(map(str, rows)) == brute(docs, target, most, buckets, least, percent, seed)
    return rows


DOCS = [(i, f"Word{i % 7} and word{i % 5}, Ärger {i % 3} \U0001f600x-{i % 11}\x00y") for i in range(60)]
TARGET = ["word1 and word2", None, "", "ärger ÄRGER word1 \U0001f600x"]


def test_against_brute_force(spark):
    check(spark, DOCS, TARGET)
    check(spark, DOCS, TARGET, most=3, buckets=997)


def test_nulls_copies_and_long_texts(spark):
    docs = [*DOCS, (None, None), (None, "a b c d"), (None, "a b c d"), (3, ""), (3, "   "), (5, "one two three"), (5, "one two three"), (99, "lorem ipsum " * 30_000)]
    rows = check(spark, docs, TARGET)
    ranks = sorted(r[5] for r in rows if r[5] is not None)
    assert ranks == list(range(1, len(ranks) + 1))


def test_many_copies_of_one_row_take_ranks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(rs, "COPIES", 7)
    monkeypatch.setattr(rs, "RANGE_ROWS", 5)
    check(spark, [*DOCS, *[(4, "and and and and")] * 100], TARGET, percent=100)


def test_empty_tables(spark):
    check(spark, DOCS, [])
    assert check(spark, [], TARGET) == []


def test_plan_has_no_python_and_broadcasts_the_gains(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    gain = rs.gains(docs, docs, "text", "text", 1, 50)
    plan = rs.weights(docs, gain, "doc_id", "text", 1, 50)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin [" not in plan.split("Generate")[0]
