"""Exact Jaccard self-join of shingle sets, as classes of linked documents.

Two sets link when their Jaccard similarity reaches `percent` of a hundred.  All
tokens have one global order, rare ones first; two sets that link share a token
in the first n - ceil(percent * n / 100) + 1 of each (prefix filter), so every
set is listed under those tokens only.

* A token's list is sorted by set size, then by the token's position in the set.
  Sizes and positions bound the overlap, so whole blocks of a list are skipped
  at once, and parity bitmaps of the sets (a lower bound of the difference) drop
  most of what is left.
* Answers are shared between highly similar sets.  First each slice of lists
  proposes only a forest of nearest pairs; those are checked on the whole sets.
  Sets that turn out to be linked have one component, so a set takes over the
  answers of its neighbours and only pairs of different components are still
  compared, all of them, again on the whole sets.

So a dense group costs about one check for each member, yet no link between
different components is lost.  Sets are dealt as packed lists: one message for
each slice that a chunk of documents has something for, so messages never
outnumber listed tokens.  Tokens that a bounded sample (`SAMPLE` texts) shows to
be common come last in the order (any order is exact) and their lists are split
into blocks of about `BLOCK` sets; the second pass meets every block with the
sets outside the list's largest component.

Defined results: a null text, or one without words, has the empty set, linked
with nothing; equal sets always link, whatever their ids; a null id is never the
smallest of a class, and a class of null ids has a null class id; repeated rows
are kept; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._base import as_bytes, checkpointed, expand, mixed, narrow, pack_arrays, slices, unpack_arrays
from cellweave.llm._words import LANES, codes, split_columns, window_hashes, word_lanes
from cellweave.llm.components import components

#: Texts that the token order is fitted on, the fewest of them that make a token common, and the common tokens kept.
SAMPLE = 10_000
COMMON = 4
MOST_COMMON = 1 << 19
#: Sets that a block of a common token's list is to hold; listed tokens of a slice; pairs held at once.
BLOCK = 256
SLICE = 1_500_000
FRONTIER = 1 << 20
#: Rows of chosen sets that may be broadcast (48 bytes each); beyond, texts are shuffled to them.
BROADCAST_ROWS = 200_000
TEXT_BYTES = 12 << 20


def shingle_sets(texts: list, shingle: int) -> list[np.ndarray]:
    """For each text the distinct 64-bit hashes of its lower-cased word runs, ascending; the whole sequence if shorter."""
    words, bounds = split_columns([t.lower() if t else t for t in texts])
    if not len(words):
        return [np.empty(0, np.uint64) for _ in texts]
    number, names = codes(words)
    values = word_lanes(names)[number, 0]
    hashes = mixed(window_hashes(values, shingle, LANES[0]))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        n = b - a
        if n >= shingle:
            out.append(np.unique(hashes[a : b - shingle + 1]))
        else:
            out.append(mixed(window_hashes(values[a:b], int(n), LANES[0]), int(n)) if n else np.empty(0, np.uint64))
    return out


def prefix_length(n, percent: int):
    """Tokens of a set of n under which it is listed."""
    return n - -(-percent * n // 100) + 1


def least_overlap(a, b, percent: int):
    """Common tokens that sets of these sizes need."""
    return -(-percent * (a + b) // (100 + percent))


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens' hashes; a power of two of 64-bit words, about three quarters of the set's size in bits."""
    bits = 64
    while 4 * bits < 3 * len(tokens):
        bits *= 2
    odd = np.bincount((mixed(tokens, 5) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _common(texts: DataFrame, shingle: int, rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(tokens ascending, how often in the sample, texts in the sample) of the common tokens."""
    share = min(1.0, SAMPLE / max(rows, 1))
    picked = texts.select("key", "text").where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).groupBy("key").agg(F.first("text").alias("text"))

    def tokens(batches):
        for table in slices(batches, "text", TEXT_BYTES):
            sets = shingle_sets(as_bytes(table.column("text").combine_chunks()), shingle)
            yield pa.RecordBatch.from_pydict({"tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})

    listed = checkpointed(picked.mapInArrow(tokens, "tokens array<long>"))
    counted = listed.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON)
    found = counted.orderBy(F.desc("n"), "token").limit(MOST_COMMON).toArrow()
    token = found.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], found.column("n").to_numpy().astype(np.int64)[order], listed.count()


def _postings(texts: DataFrame, shingle: int, percent: int, slices_n: int, rows: int, common) -> DataFrame:
    """(slice, body): packed listings of different sets, from every text."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def deal(batches):
        names, often, sampled = shared.value
        for table in slices(batches, "text", TEXT_BYTES):
            seen = {}
            for tokens in shingle_sets(as_bytes(table.column("text").combine_chunks()), shingle):
                if len(tokens):
                    seen.setdefault(_digest(tokens), tokens)
            if not seen:
                continue
            sizes = np.array([len(t) for t in seen.values()], np.int64)
            flat, owner = np.concatenate(list(seen.values())), np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(names, flat), max(len(names) - 1, 0))
            count = np.where(names[at] == flat, often[at], 0) if len(names) else np.zeros(len(flat), np.int64)
            order = np.argsort(owner * (1 << 32) + count, kind="stable")  # by set, how common, token
            flat, count = flat[order], count[order]
            place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            head = place < prefix_length(sizes, percent)[owner]
            token, count, place, owner = flat[head], count[head], place[head], owner[head]
            # A common token's list is dealt into blocks twice, so that blocks overlap.
            blocks = -(-count * rows // max(sampled, 1) // BLOCK)
            lanes = np.frombuffer(b"".join(seen), np.uint64).reshape(-1, 2)
            split = np.flatnonzero(blocks > 1)
            salt = np.zeros(len(token), np.int64)
            salt[split] = 1 + (lanes[owner[split], 0] % blocks[split].astype(np.uint64)).astype(np.int64)
            second = -1 - (lanes[owner[split], 1] % blocks[split].astype(np.uint64)).astype(np.int64)
            token, salt, place, owner = np.r_[token, token[split]], np.r_[salt, second], np.r_[place, place[split]], np.r_[owner, owner[split]]
            part = (mixed(token ^ mixed(salt.view(np.uint64), 3), 9) % np.uint64(slices_n)).astype(np.int64)
            order = np.lexsort((owner, part))
            part, token, salt, place, owner = (x[order] for x in (part, token, salt, place, owner))
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            keys, bodies = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                own, index = np.unique(owner[a:b], return_inverse=True)
                keys.append(int(part[a]))
                bodies.append(pack_arrays(token=token[a:b], salt=salt[a:b].astype(np.int32), place=narrow(place[a:b]), set=narrow(index), size=narrow(sizes[own]), digest=lanes[own].ravel()))
            yield pa.RecordBatch.from_pydict({"slice": pa.array(keys, pa.int64()), "body": pa.array(bodies, pa.binary())})

    return texts.select("text").mapInArrow(deal, "slice long, body binary")


class Lists:
    """Token lists of a slice, each sorted by set size and then position; `set` indexes `digest`."""

    def __init__(self, bodies: list[bytes]):
        parts = [unpack_arrays(b) for b in bodies]
        lanes = np.concatenate([p["digest"].reshape(-1, 2) for p in parts])
        shift = np.cumsum([0, *(len(p["size"]) for p in parts[:-1])])
        digest, first, back = np.unique(lanes.view([("a", "u8"), ("b", "u8")]).ravel(), return_index=True, return_inverse=True)
        size = np.concatenate([p["size"].astype(np.int64) for p in parts])[first]
        token = np.concatenate([p["token"] for p in parts])
        salt = np.concatenate([p["salt"] for p in parts]).astype(np.int64)
        place = np.concatenate([p["place"].astype(np.int64) for p in parts])
        owner = back.ravel()[np.concatenate([p["set"].astype(np.int64) + s for p, s in zip(parts, shift)])]
        order = np.lexsort((owner, place, size[owner], salt, token))
        token, salt, place, owner = token[order], salt[order], place[order], owner[order]
        fresh = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])] if len(token) else np.empty(0, bool)
        once = fresh | np.r_[True, owner[1:] != owner[:-1]][: len(token)]  # copies met in several chunks
        token, salt, place, owner = token[once], salt[once], place[once], owner[once]
        starts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]) if len(token) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[starts, len(token)])
        # A split list's blocks meet later, so single sets of them stay.
        listed = (lengths > 1) | (salt[starts] > 0)
        live = np.repeat(listed, lengths)
        self.token, self.salt, self.place, owner = token[live], salt[live], place[live], owner[live]
        kept, self.set = np.unique(owner, return_inverse=True)
        self.digest, self.size = lanes[first][kept], size[kept]
        lengths = lengths[listed]
        self.list = np.repeat(np.arange(len(lengths)), lengths)

    def body(self) -> bytes:
        return pack_arrays(token=self.token, salt=self.salt.astype(np.int32), place=narrow(self.place), set=narrow(self.set), size=narrow(self.size), digest=self.digest.ravel())

    def pairs(self, percent: int, comp: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of sets (the smaller first) whose sizes and positions leave room for the overlap, by blocks.

        `comp`: only pairs of different components, from lists that hold several.
        """
        n = self.size[self.set]
        if not len(n):
            return
        key = self.list << 33 | n
        room = n - self.place
        # Largest partner: by size alone, and by the tokens that follow this position.
        most = np.minimum(100 * n // percent, room * (100 + percent) // percent - n)
        stop = np.searchsorted(key, self.list << 33 | np.maximum(most, 0), side="right")
        count = np.maximum(stop - np.arange(len(n)) - 1, 0)
        if comp is not None:
            here = comp[self.set]
            first = np.flatnonzero(np.r_[True, self.list[1:] != self.list[:-1]])
            several = np.minimum.reduceat(here, first) != np.maximum.reduceat(here, first)
            count = np.where(several[self.list], count, 0)
        done, total = 0, np.cumsum(count)
        while done < len(n):
            base = total[done - 1] if done else 0
            upto = max(done + 1, int(np.searchsorted(total, base + FRONTIER, side="right")))
            a, b = np.repeat(np.arange(done, upto), count[done:upto]), expand(np.arange(done, upto) + 1, count[done:upto])
            keep = np.minimum(room[a], room[b]) >= least_overlap(n[a], n[b], percent)
            if comp is not None:
                keep &= here[a] != here[b]
            a, b = self.set[a[keep]], self.set[b[keep]]
            both = np.unique(np.minimum(a, b) * len(self.size) + np.maximum(a, b))
            if len(both):
                yield both // len(self.size), both % len(self.size)
            done = upto


class Bitmaps:
    """Parity bitmaps of sets; a pair is compared at the smaller width, to which the larger is folded."""

    def __init__(self, bodies: list[bytes]):
        self.width = np.array([len(b) // 8 for b in bodies], np.int64)
        self.rows, self.index = {}, {}
        for w in np.unique(self.width):
            own, twice = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            words = np.frombuffer(b"".join(bodies[i] for i in own), np.uint64).reshape(-1, w)
            wide = np.frombuffer(b"".join(bodies[i] for i in twice), np.uint64).reshape(-1, 2 * w)
            self.rows[w] = np.concatenate([words, wide[:, :w] ^ wide[:, w:]])
            self.index[w] = np.full(len(bodies), -1)
            self.index[w][np.r_[own, twice]] = np.arange(len(own) + len(twice))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A lower bound of the number of tokens in which the sets differ."""
        out = np.zeros(len(a), np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            x, y = self.index[w][a[at]], self.index[w][b[at]]
            known = (x >= 0) & (y >= 0)  # widths further apart than twice: sizes too far apart for any bound here
            x, y, at = x[known], y[known], at[known]
            for s in range(0, len(at), 1 << 16):
                cut = slice(s, s + (1 << 16))
                out[at[cut]] = np.bitwise_count(self.rows[w][x[cut]] ^ self.rows[w][y[cut]]).sum(axis=1)
        return out


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Positions of the pairs that make a spanning forest of least differences."""
    order = np.lexsort((b, a, apart))
    a, b = a[order], b[order]
    label, kept, live = np.arange(n), [], np.arange(len(order))
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            break
        best = np.full(n, len(order))
        np.minimum.at(best, label[a[live]], live)
        np.minimum.at(best, label[b[live]], live)
        chosen = np.unique(best[best < len(order)])
        kept.append(chosen)
        x, y, parent = label[a[chosen]], label[b[chosen]], np.arange(n)
        while (parent[x] != parent[y]).any():
            low = np.minimum(parent[x], parent[y])
            np.minimum.at(parent, parent[x], low)
            np.minimum.at(parent, parent[y], low)
            parent = parent[parent]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label = parent[label]
    return order[np.concatenate(kept)] if kept else np.empty(0, np.int64)


def _near(pairs, size: np.ndarray, maps: Bitmaps, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for a, b in pairs:
        apart = maps.apart(a, b)
        both = size[a] + size[b]
        keep = apart <= both - 2 * least_overlap(size[a], size[b], percent)
        yield a[keep], b[keep], apart[keep]


_EDGE = "a binary, b binary"


def _edges(digest: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Pairs as digests, the smaller first."""
    names = [d.tobytes() for d in digest]
    both = [(names[x], names[y]) if names[x] < names[y] else (names[y], names[x]) for x, y in zip(a.tolist(), b.tolist())]
    return pa.table({"a": pa.array([x for x, _ in both], pa.binary()), "b": pa.array([y for _, y in both], pa.binary())})


def _propose(lists: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of each slice.

    Without components (column `comp` null) a forest of nearest pairs, with them every near pair of two components.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _edges(np.empty((0, 2), np.uint64), np.empty(0, int), np.empty(0, int))
        held = Lists([left.column("body")[0].as_py()])
        at = {d: i for i, d in enumerate(right.column("digest").to_pylist())}
        order = [at[d.tobytes()] for d in held.digest]
        bodies, comps = right.column("bitmap").to_pylist(), right.column("comp").to_pylist()
        maps = Bitmaps([bodies[i] for i in order])
        a = b = apart = np.empty(0, np.int64)
        if comps and comps[0] is None:
            for x, y, d in _near(held.pairs(percent), held.size, maps, percent):
                a, b, apart = np.r_[a, x], np.r_[b, y], np.r_[apart, d]
                chosen = nearest_forest(len(held.size), a, b, apart)
                a, b, apart = a[chosen], b[chosen], apart[chosen]
            return _edges(held.digest, a, b)
        comp = np.unique(np.array([comps[i] for i in order], "S16"), return_inverse=True)[1] if order else np.empty(0, int)
        found = [(x, y) for x, y, _ in _near(held.pairs(percent, comp), held.size, maps, percent)]
        if not found:
            return _edges(held.digest, a, b)
        both = np.unique(np.concatenate([x * len(held.size) + y for x, y in found]))
        return _edges(held.digest, both // len(held.size), both % len(held.size))

    return lists.groupBy("slice").cogroup(facts.groupBy("slice")).applyInArrow(meet, _EDGE)


def _overlaps(edges: DataFrame, sets: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(a, b, linked): every edge, checked on the whole sets."""
    edges = checkpointed(edges)
    nodes = edges.select(F.col("a").alias("digest")).unionByName(edges.select(F.col("b").alias("digest"))).distinct()
    chosen = checkpointed(sets.join(nodes, "digest", "left_semi").select(F.col("rep.id").alias("rep_id"), F.col("rep.key").alias("rep_key")))
    few = chosen.count() <= BROADCAST_ROWS
    same = F.col("key").eqNullSafe(F.col("rep_key")) & F.col("id").eqNullSafe(F.col("rep_id"))
    picked = texts.join(F.broadcast(chosen) if few else chosen, same, "left_semi").select("text")

    def read(batches):
        for table in slices(batches, "text", TEXT_BYTES):
            found = shingle_sets(as_bytes(table.column("text").combine_chunks()), shingle)
            yield pa.RecordBatch.from_pydict({"digest": pa.array([_digest(s) for s in found], pa.binary()), "body": pa.array([s.tobytes() for s in found], pa.binary())})

    bodies = checkpointed(picked.mapInArrow(read, "digest binary, body binary").dropDuplicates(["digest"]))
    one, two = (bodies.select(F.col("digest").alias(c), F.col("body").alias(f"{c}_body")) for c in ("a", "b"))

    def compare(batches):
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("a_body").to_pylist(), batch.column("b_body").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    joined = edges.join(one, "a").join(two, "b").select("a", "b", "a_body", "b_body")
    return checkpointed(joined.mapInArrow(compare, f"{_EDGE}, linked boolean"))


def _across_blocks(lists: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Near pairs of different components from the lists that were split into blocks.

    Sets outside a list's largest component meet every block of it; the others stay in their own.
    """

    def rows(batches):
        for batch in batches:
            for body in batch.column("body").to_pylist():
                held = Lists([body])
                at = np.flatnonzero(held.salt > 0)
                yield pa.RecordBatch.from_pydict({"token": pa.array(held.token[at].view(np.int64)), "digest": pa.array([held.digest[i].tobytes() for i in held.set[at]], pa.binary()), "place": pa.array(held.place[at], pa.int64())})

    listed = checkpointed(lists.select("body").mapInArrow(rows, "token long, digest binary, place long").join(known.select("digest", "comp"), "digest"))
    counted = listed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("token").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all")).where(F.col("top.n") < F.col("all"))
    main = main.select("token", F.col("top.comp").alias("main"), F.ceil(F.col("all") / BLOCK).alias("blocks"))
    own = listed.join(main, "token").withColumn("own", F.pmod(F.xxhash64("digest"), F.col("blocks")))
    dealt = own.withColumn("block", F.explode(F.when(F.col("comp") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))))
    faced = dealt.join(known.select("digest", "n", "bitmap"), "digest").select("token", "block", "digest", "n", "place", "comp", "main", "own", "bitmap")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, place, own = (table.column(c).to_numpy() for c in ("n", "place", "own"))
        order = np.lexsort((place, n))
        block, digests = table.column("block")[0].as_py(), table.column("digest").to_pylist()
        comps = np.array(table.column("comp").to_pylist(), "S16")
        outside = comps != np.array(table.column("main").to_pylist(), "S16")
        maps = Bitmaps(table.column("bitmap").to_pylist())
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for x in np.flatnonzero(outside):
            y = order
            # Two sets outside the main component meet in the block of the first.
            y = y[(comps[y] != comps[x]) & (~outside[y] | ((own[x] == block) & (y != x)))]
            y = y[np.minimum(n[x] - place[x], n[y] - place[y]) >= least_overlap(n[x], n[y], percent)]
            for p, q, _ in _near([(np.full(len(y), x), y)], n, maps, percent):
                a.append(p)
                b.append(q)
        lanes = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
        return _edges(lanes, np.concatenate(a), np.concatenate(b))

    return faced.groupBy("token", "block").applyInArrow(meet, _EDGE)


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, class_id) of every document; class_id is the smallest id reachable by links of `percent` or more."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    cleaned = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).select("id", F.unhex(F.md5("text")).alias("key"), "text")

    def scan(batches):
        for table in slices(batches, "text", TEXT_BYTES):
            table = table.combine_chunks()
            sets = shingle_sets(as_bytes(table.column("text").combine_chunks()), shingle)
            yield pa.RecordBatch.from_pydict({
                "id": table.column("id").combine_chunks(), "key": table.column("key").combine_chunks().cast(pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "digest": pa.array([_digest(s) for s in sets], pa.binary()), "bitmap": pa.array([bitmap(s) for s in sets], pa.binary()),
            })

    found = checkpointed(cleaned.mapInArrow(scan, "id long, key binary, n long, digest binary, bitmap binary"))
    sets = checkpointed(found.where("n > 0").groupBy("digest").agg(F.min("id").alias("least"), F.min(F.struct("id", "key")).alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")))
    size = sets.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1), F.lit(0)).alias("listed")).first()
    links = _links(cleaned, sets, size["rows"], size["listed"], shingle, percent)
    roots = components(links, "a", "b").select(F.col("node").alias("digest"), "root")
    rooted = sets.join(roots, "digest", "left").select("digest", "least", F.coalesce("root", "digest").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    classed = rooted.join(least, "root").select("digest", "class_id")
    some = found.where("n > 0").join(classed, "digest").select("id", F.col("n").alias("n_shingles"), "class_id")
    return some.unionByName(found.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("class_id")))


def _links(texts: DataFrame, sets: DataFrame, rows: int, listed: int, shingle: int, percent: int) -> DataFrame:
    """(a, b): links between different sets that connect all that any links connect."""
    common = _common(texts, shingle, rows)
    messages = _postings(texts, shingle, percent, max(8, -(-listed // SLICE)), rows, common)

    def gather(table: pa.Table) -> pa.Table:
        held = Lists(table.column("body").to_pylist())
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int64()), "body": pa.array([held.body()], pa.binary())})

    def members(batches):
        for batch in batches:
            for part, body in zip(batch.column("slice").to_pylist(), batch.column("body").to_pylist()):
                digest = unpack_arrays(body)["digest"].reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"slice": pa.array([part] * len(digest), pa.int64()), "digest": pa.array([d.tobytes() for d in digest], pa.binary())})

    lists = checkpointed(messages.groupBy("slice").applyInArrow(gather, "slice long, body binary"))
    facts = lists.mapInArrow(members, "slice long, digest binary").join(sets.select("digest", "n", "bitmap"), "digest")
    first = _overlaps(_propose(lists, facts.select("slice", "digest", "bitmap", F.lit(None).cast("binary").alias("comp")), percent).distinct(), sets, texts, shingle, percent)
    linked = first.where("linked").select("a", "b")
    roots = components(linked, "a", "b").select(F.col("node").alias("digest"), F.col("root").alias("comp"))
    known = checkpointed(sets.select("digest", "n", "bitmap").join(roots, "digest", "left").withColumn("comp", F.coalesce("comp", "digest")))
    again = lists.mapInArrow(members, "slice long, digest binary").join(known, "digest").select("slice", "digest", "bitmap", "comp")
    rest = _propose(lists, again, percent).unionByName(_across_blocks(lists, known, percent)).distinct()
    rest = checkpointed(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return linked
    return linked.unionByName(_overlaps(rest, sets, texts, shingle, percent).where("linked").select("a", "b"))
