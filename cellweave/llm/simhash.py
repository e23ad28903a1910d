"""SimHash near-duplicate detection with the Gray-order hierarchical index.

Two uses share the index of ``hamming.py``:

* ``simhash_classes``: 64-bit fingerprints of word shingles, linked at a few
  differing bits, exactly (pigeonhole routing, every link counts).
* ``near_duplicate_classes``: wider fingerprints of five-word shingles find the
  candidates; their shingle sets decide whether the similarity is 0.8 or more.

Defined results: a null text has no words, so its fingerprint is zero, linked
like any other; a null id is kept as a row of its own and never the smallest
id of a class (a class of null ids only has a null class id); repeated rows
and copies share a class; an empty table gives an empty result; further columns
of the input are neither read nor returned.
"""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.llm import hamming
from cellweave.llm._base import as_bytes, checkpointed
from cellweave.llm.components import components

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_digests(text: bytes | None, shingle: int, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """For each seed the XXH64 digests (8 bytes, highest first) of the lower-cased text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return [np.empty((0, 8), np.uint8) for _ in seeds]
    joined = b" ".join(words)
    if len(words) < shingle:
        spans = [joined]
    else:
        starts = list(accumulate((len(w) + 1 for w in words), initial=0))
        spans = [joined[a : b - 1] for a, b in zip(starts, starts[shingle:])]
    digest = xxhash.xxh64_digest
    return [np.frombuffer(b"".join([digest(s, seed) for s in spans]), np.uint8).reshape(-1, 8) for seed in seeds]


def fingerprint(text: bytes | None, shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> bytes:
    """One 64-bit word for each seed, highest byte first: a bit is set if over half the digests have it."""
    out = []
    for digests in shingle_digests(text, shingle, seeds):
        counts = np.concatenate([np.bincount(digests[:, k], minlength=256) @ _BITS for k in range(8)])
        out.append(int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big"))
    return np.array(out, ">u8").tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """(id, print): one row for each document."""

    def scan(batches):
        for batch in batches:
            prints = [fingerprint(t, shingle, seeds) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(prints, pa.binary())], names=["id", "print"])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(scan, "id long, print binary")


def _classes(found: DataFrame, words: int, radius: int, tables) -> DataFrame:
    """(id, print, class_id) from (id, print)."""
    found = checkpointed(found)
    distinct = checkpointed(found.groupBy("print").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).withColumn("node", F.monotonically_increasing_id()))
    layout = tables(distinct.count()) if callable(tables) else tables
    edges = hamming.links(distinct.select("node", "print"), words, radius, layout)
    roots = components(edges, "a", "b")
    joined = distinct.join(roots, "node", "left").select("print", "least", F.coalesce("root", "node").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    return found.join(joined.join(least, "root").select("print", "class_id"), "print")


def simhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """(id, fingerprint, class_id): 64-bit fingerprints linked at `radius` or fewer differing bits.

    `fingerprint` is 16 lowercase hex digits; `class_id` the smallest id that is
    reachable over links.  Every link is found: the index is routed by radius + 1
    disjoint blocks of bits.
    """
    classed = _classes(fingerprints(docs, doc_id, text, shingle, (seed,)), 1, radius, hamming.blocks(64, radius + 1))
    return classed.select("id", F.lower(F.hex("print")).alias("fingerprint"), "class_id")


#: Fingerprint words of near_duplicate_classes, and the bits they have.
WIDE = 4


def bits_apart(similarity: float) -> float:
    """Expected share of differing bits of two shingle sets of that Jaccard similarity and equal size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_tables(n: int, similarity: float, missed: float = 0.01) -> list[list[int]]:
    """Groups of bit positions so that two sets of the similarity agree on one but for a share of `missed`.

    The number of positions grows with log2 of the fingerprints, so that an
    index holds about a thousand unrelated ones at any size.
    """
    bits = 64 * WIDE
    width = max(6, math.ceil(math.log2(max(n, 2) / 1000)))
    agree = (1 - bits_apart(similarity)) ** width
    count = math.ceil(math.log(missed) / math.log(1 - agree))
    out = []
    for t in range(count):
        turn = np.argsort(hamming.mixed(np.arange(bits, dtype=np.uint64), 1000 + t * width // bits), kind="stable")
        first = t * width % bits
        out.append(sorted(int(turn[(first + k) % bits]) for k in range(width)))
    return out


#: Standard deviations of the differing bits that candidates are taken beyond their mean at the threshold.
MARGIN = 3.0
#: Bytes of shingle digests that one side of a comparison holds; shingle bytes that a group of comparisons aims at.
BLOCK_BYTES = 16 << 20
GROUP_BYTES = 8 << 20


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, class_id): classes of documents linked by a shingle similarity (Jaccard) of `similarity` or more.

    Fingerprints of 256 bits find the candidates, at a radius of `MARGIN`
    standard deviations beyond the differing share expected at the threshold;
    a link needs the similarity of the shingle sets themselves.  Exact copies,
    and texts without words, always share a class.
    """
    found, joined = _near(docs, doc_id, text, shingle, similarity)
    least = joined.groupBy("root").agg(F.min("least").alias("class_id"))
    return found.join(joined.join(least, "root").select("key", "class_id"), "key").select("id", "class_id")


def _near(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id, key, print) of each row, `key` a digest of its text; (key, least id, root) of each text."""
    bits = 64 * WIDE
    share = bits_apart(similarity)
    radius = int(bits * share + MARGIN * math.sqrt(bits * share * (1 - share)))
    seeds = tuple(range(42, 42 + WIDE))
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("id", F.unhex(F.md5("text")).alias("key"), "text")

    def scan(batches):
        for batch in batches:
            prints = [fingerprint(t, shingle, seeds) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.binary()), pa.array(prints, pa.binary())], names=["id", "key", "print"])

    found = checkpointed(named.mapInArrow(scan, "id long, key binary, print binary"))
    distinct = checkpointed(found.groupBy("key", "print").agg(F.min("id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    near = components(hamming.links(distinct.select("node", "print"), WIDE, radius, sampled_tables(distinct.count(), similarity)), "a", "b")
    edges = _similar(named, distinct.join(near, "node").select("key", "print", "node", "root"), shingle, similarity, radius)
    return found, distinct.join(components(edges, "a", "b"), "node", "left").select("key", "least", F.coalesce("root", "node").alias("root"))


def _similar(named: DataFrame, members: DataFrame, shingle: int, similarity: float, radius: int) -> DataFrame:
    """Edges (a, b) that connect the members of each candidate group (`root`) whose shingle sets are similar.

    Groups of more than `BLOCK_BYTES` are dealt into blocks, and each pair of blocks is compared in a task of its own.
    """

    def digest(batches):
        for batch in batches:
            sets = [np.unique(shingle_digests(t, shingle, (42,))[0].view(np.uint64)).tobytes() for t in as_bytes(batch.column(3))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["node", "root", "print", "shingles"])

    texts = named.groupBy("key").agg(F.first("text").alias("text"))
    sets = checkpointed(texts.join(members, "key").select("node", "root", "print", "text").mapInArrow(digest, "node long, root long, print binary, shingles binary"))
    sizes = sets.groupBy("root").agg(F.ceil(F.sum(F.octet_length("shingles") + 100) / BLOCK_BYTES).alias("blocks")).where("blocks > 1")
    dealt = sets.join(sizes, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bucket", F.xxhash64("root", F.least("block", "other"), F.greatest("block", "other"))).withColumn("cross", F.col("blocks") > 1)
    total = sets.agg(F.sum(F.octet_length("shingles") + 100).alias("n")).first()["n"] or 0

    def compare(table: pa.Table) -> pa.Table:
        a, b = _compare(table.combine_chunks(), similarity, radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    groups = max(64, -(-total // GROUP_BYTES))
    return dealt.select("bucket", "node", "print", "shingles", "block").groupBy(F.pmod("bucket", F.lit(groups))).applyInArrow(compare, "a long, b long")


def _compare(table: pa.Table, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of each bucket that are within the radius and similar."""
    index = hamming.GrayIndex(hamming.as_rows(table.column("print"), WIDE), table.column("bucket").to_numpy())
    sets = [np.frombuffer(body, np.uint64) for body in table.column("shingles").take(pa.array(index.order)).to_pylist()]
    node = table.column("node").to_numpy()[index.order]
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark, label = np.zeros(len(names), np.int32), np.arange(len(sets))
    first = np.cumsum(index.sizes) - index.sizes
    span = np.repeat(np.arange(len(first)), index.sizes)
    a, b = [], []
    for query, near in index.pairs(radius):
        cut = np.flatnonzero(np.r_[True, query[1:] != query[:-1], True]) if len(query) else np.zeros(1, np.int64)
        for x, y in zip(cut[:-1], cut[1:]):
            q, others = query[x], near[x:y]
            others = others[label[others] != label[q]]
            # |A & B| / |A | B| is at most the smaller size over the larger.
            others = others[np.minimum(sizes[others], sizes[q]) >= similarity * np.maximum(sizes[others], sizes[q]) * (1 - 1e-9)]
            if not len(others):
                continue
            if not sizes[q]:
                same = others  # neither has a word
            else:
                mark[flat[starts[q] : starts[q] + sizes[q]]] = 1
                seen = mark[flat[hamming.expand(starts[others], sizes[others])]]
                both = np.add.reduceat(seen, np.cumsum(sizes[others]) - sizes[others])
                mark[flat[starts[q] : starts[q] + sizes[q]]] = 0
                same = others[both / (sizes[others] + sizes[q] - both) >= similarity]
            if len(same):
                _, one = np.unique(label[same], return_index=True)
                a += [node[q]] * len(one)
                b += node[same[one]].tolist()
                here = slice(first[span[q]], first[span[q]] + index.sizes[span[q]])
                label[here][np.isin(label[here], label[same])] = label[q]
    return np.array(a, np.int64), np.array(b, np.int64)


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each near-duplicate class, with all of its columns.

    The smallest id stays, and a document without an id only where its class has
    none; of different texts with that id (or none) the one with the least MD5.
    Rows are told apart by id and text, so different texts that share an id all
    stay; of repeated rows the one whose columns have the least hash stays.
    """
    found, joined = _near(docs, doc_id, text, shingle, similarity)
    of_class = joined.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("nameless"), F.col("least").alias("id"), "key")).alias("first"))
    rows = found.groupBy("id", "key").agg(F.count(F.lit(1)).alias("rows"))
    firsts = of_class.select(F.col("first.id").alias("__id"), F.col("first.key").alias("__key"))
    kept = rows.join(firsts, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left_semi")
    kept = checkpointed(kept.select(F.col("id").alias("__kept_id"), F.col("key").alias("__kept_key"), F.col("rows").alias("__kept_rows")))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col("__kept_id")) & (F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))) == F.col("__kept_key"))
    once = docs.join(kept.where("__kept_rows = 1"), same, "left_semi")
    # Only repeated rows are sorted, and each partition keeps one of each.
    order = Window.partitionBy("__kept_id", "__kept_key").orderBy(F.xxhash64(*(n for n, t in docs.dtypes if "map<" not in t and "variant" not in t)))
    often = docs.join(kept.where("__kept_rows > 1"), same).withColumn("__kept_row", F.row_number().over(order)).where("__kept_row = 1")
    return once.unionByName(often.select(*docs.columns))
