"""Gray-order hierarchical index over binary fingerprints, and its distributed self-join.

The index sorts fingerprints by Gray rank, which puts fingerprints that share
bits next to each other, and groups neighbours into nodes.  A node keeps the
bits that all of its members share; bits shared already by the parent are
factored out, so each bit is compared once on a path.  A search carries the
differences accumulated on the way down and drops a whole group as soon as
they exceed the radius.

Pairs are routed to the same index by *keys*: groups of bit positions on which
two fingerprints must agree.  With `radius + 1` disjoint blocks that cover the
fingerprint, any two within the radius agree on one block, so nothing is lost
(pigeonhole).  Blocks whose index would exceed `bucket` members are split by
the same rule over their remaining bits, to any depth; copies are never dropped.
At a wide radius that rule would copy every row `radius + 1` times a round, so
there a dense block is compared in pieces (`_pieces`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._base import checkpointed, expand, mixed
from cellweave.llm.components import components

FANOUT = 8
#: Blocks that a hot bucket is split by at most; at a wider radius it is compared in pieces.
SPLITS = 8
#: Pairs that a search step holds at most, so memory does not follow the bucket's size.
FRONTIER = 1 << 20


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the binary-reflected Gray sequence."""
    rank = values.astype(np.uint64).copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index over rows of 64-bit words; `bucket` splits it into independent trees."""

    def __init__(self, prints: np.ndarray, bucket: np.ndarray):
        ranks = [gray_rank(prints[:, w]) for w in range(prints.shape[1])]
        self.order = np.lexsort((*reversed(ranks), bucket))
        self.prints = prints[self.order]
        self.bucket = bucket[self.order]
        n = len(self.order)
        starts = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]]) if n else np.empty(0, np.int64)
        self.sizes = np.diff(np.r_[starts, n])
        #: Levels from the leaves (single fingerprints) up; each node: first child, child count, last leaf.
        ones, zeros, last = self.prints, self.prints, np.arange(n)
        sizes = self.sizes
        levels = [(None, None, last, ones, zeros)]
        while len(last) and sizes.max() > 1:
            heads = np.cumsum(sizes) - sizes
            position = np.arange(len(last)) - np.repeat(heads, sizes)
            first = np.flatnonzero(position % FANOUT == 0)
            count = np.diff(np.r_[first, len(last)])
            ones = np.bitwise_and.reduceat(ones, first, axis=0)
            zeros = np.bitwise_or.reduceat(zeros, first, axis=0)
            last = last[first + count - 1]
            sizes = -(-sizes // FANOUT)
            levels.append((first, count, last, ones, zeros))
        #: Each node's shared bits that its parent does not share.
        self.levels = []
        for depth, (first, count, last, ones, zeros) in enumerate(levels):
            shared = ~(ones ^ zeros)
            if depth + 1 < len(levels):
                up_first, up_count, _, up_ones, up_zeros = levels[depth + 1]
                parent = np.repeat(np.arange(len(up_first)), up_count)
                shared = shared & (up_ones ^ up_zeros)[parent]
            self.levels.append((first, count, last, ones, shared))
        self.root = np.repeat(np.arange(len(self.sizes)), self.sizes)

    def _near(self, query, node, level, carried, radius):
        _, _, last, ones, shared = self.levels[level]
        apart = carried
        for w in range(self.prints.shape[1]):
            differ = (self.prints[query, w] ^ ones[node, w]) & shared[node, w]
            apart = apart + np.bitwise_count(differ)
            keep = (apart <= radius) & (last[node] > query)
            query, node, apart = query[keep], node[keep], apart[keep]
        return query, node, apart

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i < j, in index order) of all pairs within the radius, block by block."""
        n = len(self.order)
        work = np.cumsum(np.repeat(self.sizes, self.sizes))
        start = 0
        while start < n:
            done = work[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(work, done + FRONTIER, side="right")))
            query = np.arange(start, stop)
            top = len(self.levels) - 1
            query, node, apart = self._near(query, self.root[start:stop], top, np.zeros(stop - start, np.int32), radius)
            for level in range(top, 0, -1):
                first, count = self.levels[level][:2]
                fan = count[node]
                query, apart, node = np.repeat(query, fan), np.repeat(apart, fan), expand(first[node], fan)
                query, node, apart = self._near(query, node, level - 1, apart, radius)
            yield query, node
            start = stop

    def forest(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of the pairs within the radius: (row, root row) as given, without roots."""
        label = np.arange(len(self.order))
        for a, b in self.pairs(radius):
            while len(a):
                la, lb = label[a], label[b]
                keep = la != lb
                a, b, la, lb = a[keep], b[keep], la[keep], lb[keep]
                if not len(a):
                    break
                parent = np.arange(len(label))
                np.minimum.at(parent, np.maximum(la, lb), np.minimum(la, lb))
                while True:
                    further = parent[parent]
                    if (further == parent).all():
                        break
                    parent = further
                label = parent[label]
        child = np.flatnonzero(label != np.arange(len(label)))
        return self.order[child], self.order[label[child]]


def blocks(bits: int, count: int) -> list[list[int]]:
    """Bit positions 0..bits-1 (0 is the lowest) in `count` contiguous blocks of nearly equal width."""
    edges = [bits * k // count for k in range(count + 1)]
    return [list(range(edges[k], edges[k + 1])) for k in range(count)]


def taken_bits(prints: np.ndarray, positions: list[int]) -> np.ndarray:
    """The bits at the given positions, side by side as one integer."""
    out = np.zeros(len(prints), np.uint64)
    for k, p in enumerate(positions):
        out |= ((prints[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1)) << np.uint64(k)
    return out


def as_rows(column: pa.Array, words: int) -> np.ndarray:
    """Fixed-width binary fingerprints (highest byte of a word first) as rows of 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


_KEYED = "bucket long, path string, node long, print binary"


def keyed(prints: DataFrame, words: int, tables: list[list[int]]) -> DataFrame:
    """(bucket, path, node, print): each fingerprint once for each group of bit positions."""

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = as_rows(batch.column("print"), words)
            for t, positions in enumerate(tables):
                key = mixed(taken_bits(rows, positions), t).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array([str(t)] * len(rows)), batch.column("node").cast(pa.int64()), batch.column("print").cast(pa.binary())], names=["bucket", "path", "node", "print"])

    return prints.select("node", "print").mapInArrow(deal, _KEYED)


def _split(rows: DataFrame, words: int, used: dict[str, list[int]], radius: int) -> tuple[DataFrame, dict[str, list[int]]]:
    """Split hot buckets by `radius + 1` blocks of the bits that their path has not used."""
    paths = {}
    for path, positions in used.items():
        rest = [p for p in range(words * 64) if p not in set(positions)]
        cuts = blocks(len(rest), radius + 1)
        paths[path] = {f"{path}.{k}": [rest[i] for i in cut] for k, cut in enumerate(cuts)}

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            prints, path = as_rows(batch.column("print"), words), np.array(batch.column("path").to_pylist())
            bucket, node = batch.column("bucket").to_numpy(), batch.column("node")
            for p in np.unique(path):
                here = np.flatnonzero(path == p)
                for k, (name, positions) in enumerate(paths[p].items()):
                    with np.errstate(over="ignore"):
                        key = mixed(bucket[here].view(np.uint64) ^ mixed(taken_bits(prints[here], positions), k + 1), 77)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array([name] * len(here)), node.take(pa.array(here)), batch.column("print").take(pa.array(here))], names=["bucket", "path", "node", "print"])

    wider = {name: used[path] + positions for path, parts in paths.items() for name, positions in parts.items()}
    return rows.select("bucket", "path", "node", "print").mapInArrow(deal, _KEYED), wider


def links(prints: DataFrame, words: int, radius: int, tables: list[list[int]], bucket: int = 20_000, group_rows: int = 60_000) -> DataFrame:
    """Edges (a, b) that connect all fingerprints within the radius that agree on one of the tables.

    `prints` has distinct `node` (long) and `print` (binary of `words` 64-bit
    words).  Each bucket gives a spanning forest of its links, not its pairs, so
    a dense group of m gives fewer than m edges.  Tables that cover the
    fingerprint with radius + 1 disjoint blocks make the result exact.
    """
    n = prints.count() * len(tables)
    rows = keyed(prints, words, tables)
    used = {str(t): positions for t, positions in enumerate(tables)}
    out = None
    while True:
        hot = rows.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket")
        narrow = all(len(positions) + radius + 1 < words * 64 for positions in used.values())
        hot = checkpointed(hot) if narrow and n > bucket else None
        if hot is None or hot.isEmpty():
            found = _joined(rows, words, radius, max(64, -(-n // group_rows)))
            return found if out is None else out.unionByName(found)
        found = _joined(rows.join(hot, "bucket", "left_anti"), words, radius, max(64, -(-n // group_rows)))
        out = found if out is None else out.unionByName(found)
        if radius + 1 > SPLITS:
            return out.unionByName(_pieces(checkpointed(rows.join(hot, "bucket", "left_semi")), words, radius, bucket, group_rows))
        rows, used = _split(rows.join(hot, "bucket", "left_semi"), words, used, radius)
        rows = checkpointed(rows)
        n = rows.count()


def _joined(rows: DataFrame, words: int, radius: int, groups: int) -> DataFrame:
    """The forests of all buckets; a group holds many whole buckets."""

    def join(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        prints = as_rows(table.column("print"), words)
        index = GrayIndex(prints, table.column("bucket").to_numpy())
        child, root = index.forest(radius)
        node = table.column("node").to_numpy()
        return pa.table({"a": pa.array(node[child], pa.int64()), "b": pa.array(node[root], pa.int64())})

    return rows.select("bucket", "node", "print").groupBy(F.pmod("bucket", F.lit(groups))).applyInArrow(join, "a long, b long")


def _pieces(rows: DataFrame, words: int, radius: int, bucket: int, group_rows: int) -> DataFrame:
    """Edges that connect the members of buckets larger than `bucket`, with tasks of bounded size.

    A bucket is dealt twice into pieces by different hashes, and each piece gives
    its forest; as the pieces overlap, a dense group becomes one component.
    Pairs inside a bucket's largest component are connected then.  The members
    outside it are dealt into pieces of their own, each of which meets every
    piece of the bucket, so no link is lost, and rows are copied only as often
    as there are pieces outside.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("long").alias("pieces"))
    held = rows.join(sizes, "bucket")
    twice = held.withColumn("way", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("piece", F.pmod(F.xxhash64("node", "way"), F.col("pieces")))
    n = rows.count()
    first = checkpointed(_joined(twice.select(F.xxhash64("bucket", "way", "piece").alias("bucket"), "node", "print"), words, radius, max(64, -(-2 * n // group_rows))))
    roots = components(first, "a", "b")
    labelled = checkpointed(held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    counted = labelled.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    main = counted.where(F.col("top.n") < F.col("all")).select("bucket", F.col("top.root").alias("main"), F.ceil((F.col("all") - F.col("top.n")) / bucket).cast("long").alias("others"))
    dealt = labelled.join(main, "bucket").withColumns({"piece": F.pmod(F.xxhash64("node", F.lit(0)), F.col("pieces")), "other": F.pmod(F.xxhash64("node", F.lit(2)), F.col("others"))})
    every = dealt.select("bucket", "node", "print", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("other"))
    outside = dealt.where(F.col("root") != F.col("main")).select("bucket", "node", "print", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"), "other")
    met = every.unionByName(outside).select(F.xxhash64("bucket", "piece", "other").alias("bucket"), "node", "print").distinct()
    return first.unionByName(_joined(met, words, radius, max(64, -(-n // group_rows))))
