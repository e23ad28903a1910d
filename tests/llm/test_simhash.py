import numpy as np
import pytest
import xxhash

from cellweave.llm import hamming
from cellweave.llm.components import components
from cellweave.llm.simhash import drop_near_duplicates, near_duplicate_classes, simhash_classes


def brute_print(text, shingle=3):
    words = (text or "").encode().lower().split()
    spans = [b" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, radius=3):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_classes_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(120):
        words = list(rng.choice(vocabulary, rng.integers(1, 200)))
        rows.append((i * 3, " ".join(words)))
        if i % 3 == 0:
            words[rng.integers(len(words))] = "CHANGED"
            rows.append((i * 3 + 1, "\n".join(words)))
    rows += [(900, None), (901, ""), (902, " \t"), (903, rows[0][1]), (903, rows[0][1]), (None, "alone here"), (904, "One"), (905, "oNE")]
    frame = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, print string, node int")
    got = sorted(((r.id, r.fingerprint, r.class_id) for r in simhash_classes(frame).collect()), key=str)
    assert got == brute_classes(rows)
    assert simhash_classes(frame.limit(0)).count() == 0


def test_index_finds_every_pair_and_prunes():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(30)]))
    bucket = rng.integers(0, 3, len(prints))
    index = hamming.GrayIndex(prints[:, None], bucket)
    got = set()
    for a, b in index.pairs(2):
        got |= set(zip(index.order[a], index.order[b]))
    want = {(i, j) for i in range(len(prints)) for j in range(len(prints)) if i != j and bucket[i] == bucket[j] and int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert {frozenset(p) for p in got} == {frozenset(p) for p in want}
    child, root = index.forest(2)
    assert len(child) < len(prints)


def test_hot_buckets_are_split_without_loss(spark):
    rng = np.random.default_rng(3)
    values = np.unique((rng.integers(0, 1 << 12, 1500, dtype=np.uint64) << np.uint64(20)) | rng.integers(0, 4, 1500, dtype=np.uint64))
    frame = spark.createDataFrame([(i, int(v).to_bytes(8, "big")) for i, v in enumerate(values)], "node long, print binary")
    tables = hamming.blocks(64, 3)

    def classes(bucket):
        edges = hamming.links(frame, 1, 2, tables, bucket=bucket)
        return sorted((r.node, r.root) for r in components(edges, "a", "b").collect())

    assert classes(40) == classes(10_000)


def test_groups_follow_the_rows_in_every_round(spark, monkeypatch):
    """Also after a split no group aims at more than `group_rows` rows."""
    values = [(i << 30) | (i % 7) for i in range(700)]
    frame = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "node long, print binary")
    seen, joined = [], hamming._joined

    def watch(rows, words, radius, groups):
        seen.append((rows.count(), groups))
        return joined(rows, words, radius, groups)

    monkeypatch.setattr(hamming, "_joined", watch)
    hamming.links(frame, 1, 2, hamming.blocks(64, 3), bucket=300, group_rows=5).count()
    assert len(seen) > 1 and all(n <= 5 * groups for n, groups in seen) and seen[-1][1] > 64


def test_components_and_empty(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (10, 11), (7, 7), (None, 1)], "a long, b long")
    got = {(r.node, r.root) for r in components(edges, "a", "b").collect()}
    assert got == {(5, 3), (4, 3), (3, 3), (9, 3), (10, 10), (11, 10)}
    assert components(edges.limit(0), "a", "b").count() == 0


@pytest.mark.parametrize("changed, together", [(2, True), (60, False)])
def test_near_duplicates_by_similarity(spark, changed, together):
    rng = np.random.default_rng(4)
    words = [f"t{i}" for i in rng.integers(0, 5000, 400)]
    other = list(words)
    for i in rng.choice(400, changed, replace=False):
        other[i] = "changed"
    frame = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, "a b c"), (None, None)], "doc_id long, text string")
    got = {r.id: r.class_id for r in near_duplicate_classes(frame).collect()}
    assert (got[1] == got[2]) is together and got[3] == 3 and got[None] is None


def similar_pairs(shingles, similarity, count):
    """Pairs of texts whose five-word shingle sets have that Jaccard similarity, as nearly as their size allows; and the exact one."""
    out = []
    for k in range(count):
        words = [f"p{k}n{shingles}s{similarity}w{i}" for i in range(shingles + 4)]
        extra = round(shingles * (1 - similarity) / (1 + similarity))
        # Other words at the end: each takes one shingle from either side.
        other = words[: len(words) - extra] + [f"p{k}n{shingles}s{similarity}x{i}" for i in range(extra)]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words, other))
        out.append((" ".join(words), " ".join(other), len(a & b) / len(a | b)))
    return out


def test_links_need_the_similarity_itself(spark):
    pairs = [p for s in (0.65, 0.7, 0.75, 0.79, 0.8, 0.82, 0.85) for n in (153, 405) for p in similar_pairs(n, s, 40)]
    rows = [(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)]
    got = {r.id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [got[2 * i] == got[2 * i + 1] for i in range(len(pairs))]
    assert not any(k for k, p in zip(linked, pairs) if p[2] < 0.8)
    true = [k for k, p in zip(linked, pairs) if p[2] >= 0.8]
    assert len(true) >= 160 and np.mean(true) > 0.97


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    from cellweave.llm import simhash

    words = [f"t{i}" for i in range(300)]
    rows = [(i, " ".join(words[: 300 - i // 2] + [f"e{i}"])) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(near_duplicate_classes(frame).collect())
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 20_000)
    assert sorted(near_duplicate_classes(frame).collect()) == one and {r.class_id for r in one} == {0}


def test_rows_that_share_an_id_or_have_none(spark):
    """Different texts with one id stay; copies go, with or without an id; one of repeated rows stays."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(100))
    rows = [(1, text("a"), 0), (1, text("b"), 1), (2, text("c"), 2), (None, text("d"), 3), (None, text("d"), 4), (None, text("d") + " end", 5), (None, text("a"), 6), (3, text("e"), 7), (3, text("e"), 7), (5, text("c"), 8), (4, text("c") + " x", 9)]
    frame = spark.createDataFrame([(*r, {"k": r[0]}, None) for r in rows], "doc_id long, text string, key int, root map<string,long>, rows int")
    kept = drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text.split("w")[0]) for r in kept.collect()), key=str)
    assert got == sorted([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], key=str)
    assert drop_near_duplicates(frame.limit(0)).count() == 0


def test_dense_buckets_of_wide_fingerprints_meet_in_pieces(spark, monkeypatch):
    """Many variants of one template at 256 bits, with stragglers: no link is lost and rows are dealt a bounded number of times."""
    rng = np.random.default_rng(9)
    n, radius, limit = 600, 55, 60
    centre = rng.integers(0, 2, 256)
    bits = centre ^ (rng.random((n, 256)) < np.where(np.arange(n) % 10 == 0, 0.16, 0.08)[:, None])
    bits[:, :8] = centre[:8]
    prints = [np.packbits(b).tobytes() for b in bits.astype(np.uint8)]
    frame = spark.createDataFrame(list(enumerate(prints)), "node long, print binary")
    dealt, plain = [], hamming._joined
    monkeypatch.setattr(hamming, "_joined", lambda rows, *a: dealt.append(rows.count()) or plain(rows, *a))
    edges = hamming.links(frame, 4, radius, [[56, 57, 58, 59, 60, 61, 62, 63]], bucket=limit)
    got = {}

    def root(x):
        while got.setdefault(x, x) != x:
            x = got[x]
        return x

    for e in edges.collect():
        got[root(e.a)] = root(e.b)
    want = {}

    def find(x):
        while want.setdefault(x, x) != x:
            x = want[x]
        return x

    apart = (bits[:, None, :] != bits[None, :, :]).sum(axis=2)
    for i, j in zip(*np.nonzero(np.triu(apart <= radius, 1))):
        want[find(i)] = find(j)
    groups = [{frozenset(j for j in range(n) if of(j) == r) for r in {of(i) for i in range(n)}} for of in (root, find)]
    assert groups[0] == groups[1] and len(groups[0]) < n
    assert sum(dealt) <= 8 * n
