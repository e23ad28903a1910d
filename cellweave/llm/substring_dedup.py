"""Substring dedup: a Count-min prefilter, then exact grouping of the windows it lets through.

1. Each chunk of documents hashes its windows and counts them in a Count-min
   sketch (two rows), which it sends in sparse form, cut in slices of the
   counter range.
2. The slices of all chunks are added up, slice by slice, and each chunk gets
   back one bit for each counter it touched: does the merged sketch count two or
   more?  A Count-min sketch never underestimates, so a window that repeats
   anywhere has both bits.
3. Chunks send only the windows whose estimate is two or more - their first
   occurrence in the chunk, as 128-bit identities - to be grouped exactly, and
   get back which of them start earlier elsewhere.  Later occurrences in the
   same chunk need no message.
4. Chunks drop the words that a repeated, not first window covers.

The counters grow with the text (at least four for each window at five bytes a
word), and so do the slices, so that a task's share stays the same at any size.
A window that a third of all documents hold sends one message for each chunk.

Defined results: null and empty texts have no words, nothing to remove and an
empty kept text; ids order occurrences, a null id after all others, and rows
with equal ids in chunk order; repeated rows are separate documents, so the
later one loses its windows; an empty table gives an empty result; further
columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._base import as_bytes, deltas, expand, mixed, narrow, pack_arrays, to_chunks, trim, undelta, unpack_arrays, unpack_table
from cellweave.llm._words import LANES, split_columns, window_hashes, word_lanes

#: Counters that a slice of a sketch row covers at most, and candidate windows that a group compares.
SLICE_COUNTERS = 1 << 23
NO_ID = np.iinfo(np.int64).max


class _Chunk:
    """A chunk's words, and its windows in the order (id, row, position)."""

    def __init__(self, body: bytes, length: int):
        trim()
        table = unpack_table(body)
        ids = table.column("id").combine_chunks()
        self.ids = ids.to_pylist()
        order_ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.rows = np.argsort(order_ids, kind="stable")
        self.row_ids = order_ids[self.rows]
        texts = as_bytes(table.column("text").combine_chunks())
        self.words, self.bounds = split_columns([texts[i] for i in self.rows])
        coded = self.words.dictionary_encode()
        number, lanes = coded.indices.to_numpy(zero_copy_only=False), word_lanes(coded.dictionary.to_pylist())
        sizes = np.diff(self.bounds)
        windows = np.maximum(sizes - length + 1, 0)
        #: First word of each window, and the row that it is in.
        self.start = expand(self.bounds[:-1], windows)
        self.owner = np.repeat(np.arange(len(sizes)), windows)
        self.h = [window_hashes(lanes[number, k], length, LANES[k])[self.start] if len(self.start) else np.empty(0, np.uint64) for k in range(2)]

    def firsts(self) -> np.ndarray:
        """Whether each window is the first in the chunk with its words."""
        order = np.argsort(self.h[0], kind="stable")
        a, b = self.h[0][order], self.h[1][order]
        if len(a) and ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():  # one lane collides: sort by both
            order = np.lexsort((self.h[1], self.h[0]))
            a, b = self.h[0][order], self.h[1][order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
        out = np.empty(len(a), bool)
        out[order] = new
        return out

    def counters(self, bits: int) -> list[np.ndarray]:
        """Each window's counter in the two sketch rows."""
        return [mixed(h, 11 + k) >> np.uint64(64 - bits) for k, h in enumerate(self.h)]


def _sketch(length: int, bits: int, slice_bits: int):
    """(slice, chunk, body): sparse counters of each chunk; counts beyond two say no more than two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body")):
                own = _Chunk(body.as_py(), length)
                keys, numbers, bodies = [], [], []
                for row, cells in enumerate(own.counters(bits)):
                    cells = np.sort(cells)
                    head = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]) if len(cells) else np.empty(0, np.int64)
                    twice = np.diff(np.r_[head, len(cells)]) > 1
                    cells = cells[head]
                    part = (cells >> np.uint64(slice_bits)).astype(np.int64)
                    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
                    for a, b in zip(cut, np.r_[cut[1:], len(part)]):
                        low = cells[a:b] & np.uint64((1 << slice_bits) - 1)
                        keys.append(int(part[a]) << 1 | row)
                        bodies.append(pack_arrays(cell=deltas(low), twice=np.packbits(twice[a:b])))
                        numbers.append(chunk)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(bodies, pa.binary())], names=["slice", "chunk", "body"])

    return run


def _merge(slice_bits: int):
    """(chunk, slice, body): for each chunk's counters in the slice, whether the merged count is two or more."""

    def run(key, table):
        chunks = table.column("chunk").to_pylist()
        total = np.zeros(1 << slice_bits, np.uint8)
        cells = []
        for body in table.column("body"):
            got = unpack_arrays(body.as_py())
            cell = undelta(got["cell"]).astype(np.int64)
            twice = np.unpackbits(got["twice"], count=len(cell))
            total[cell] = np.minimum(total[cell] + 1 + twice, 2)
            cells.append(cell)
        bodies = [pack_arrays(many=np.packbits(total[cell] > 1)) for cell in cells]
        return pa.table({"chunk": pa.array(chunks, pa.int64()), "slice": pa.array([key[0].as_py()] * len(chunks), pa.int64()), "body": pa.array(bodies, pa.binary())})

    return run


def _candidates(length: int, bits: int, slice_bits: int, groups: int):
    """(grp, chunk, body): windows estimated repeated, once for each chunk that has them."""

    def run(key, left, right):
        empty = pa.table({"grp": pa.array([], pa.int64()), "chunk": pa.array([], pa.int64()), "body": pa.array([], pa.binary())})
        if not left.num_rows or not right.num_rows:
            return empty
        own = _Chunk(left.column("body")[0].as_py(), length)
        answers: list[dict] = [{}, {}]
        for s, body in zip(right.column("slice").to_pylist(), right.column("body")):
            answers[s & 1][s >> 1] = unpack_arrays(body.as_py())["many"]
        keep = own.firsts()
        many = [np.ones(len(keep), bool) for _ in range(2)]
        for row, cells in enumerate(own.counters(bits)):
            order = np.argsort(cells, kind="stable")
            ranked = cells[order]
            new = np.r_[True, ranked[1:] != ranked[:-1]]
            part = (ranked[new] >> np.uint64(slice_bits)).astype(np.int64)
            flags = np.empty(int(new.sum()), bool)
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            for a, b in zip(cut, np.r_[cut[1:], len(part)]):
                flags[a:b] = np.unpackbits(answers[row][int(part[a])], count=int(b - a))
            many[row][order] = flags[np.cumsum(new) - 1]
        at = np.flatnonzero(keep & many[0] & many[1])
        # The occurrence in this chunk that comes first stands for all; at is in (id, position) order.
        target = (mixed(own.h[0][at], 23) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(target, kind="stable")
        at, target = at[order], target[order]
        keys, bodies = [], []
        cut = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(at) else np.empty(0, np.int64)
        for a, b in zip(cut, np.r_[cut[1:], len(at)]):
            mine = at[a:b]
            owners = own.owner[mine]
            head = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            keys.append(int(target[a]))
            bodies.append(pack_arrays(h0=own.h[0][mine], h1=own.h[1][mine], at=deltas(mine), run=narrow(np.diff(np.r_[head, len(mine)])), id=own.row_ids[owners[head]]))
        n = len(keys)
        return pa.table({"grp": pa.array(keys, pa.int64()), "chunk": pa.array([key[0].as_py()] * n, pa.int64()), "body": pa.array(bodies, pa.binary())})

    return run


def _exact(key, table):
    """(chunk, body): which of a chunk's candidates start earlier in another chunk."""
    chunks = table.column("chunk").to_numpy()
    got = [unpack_arrays(body.as_py()) for body in table.column("body")]
    counts = np.array([len(g["h0"]) for g in got])
    h0, h1 = (np.concatenate([g[k] for g in got]) for k in ("h0", "h1"))
    ids = np.concatenate([np.repeat(g["id"], g["run"]) for g in got])
    source = np.repeat(np.arange(len(got)), counts)
    order = np.lexsort((chunks[source], ids, h1, h0))
    a, b = h0[order], h1[order]
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    later = np.empty(len(order), bool)
    later[order] = ~first
    bodies, numbers = [], []
    for k, (start, count) in enumerate(zip(np.cumsum(counts) - counts, counts)):
        flags = later[start : start + count]
        if flags.any():
            numbers.append(int(chunks[k]))
            bodies.append(pack_arrays(at=deltas(undelta(got[k]["at"])[flags])))
    return pa.table({"chunk": pa.array(numbers, pa.int64()), "body": pa.array(bodies, pa.binary())})


_OUT = "id long, n_words long, n_removed long, kept_text string"


def _finish(length: int):
    def run(key, left, right):
        if not left.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        own = _Chunk(left.column("body")[0].as_py(), length)
        repeated = ~own.firsts()
        for body in right.column("body"):
            repeated[undelta(unpack_arrays(body.as_py())["at"]).astype(np.int64)] = True
        change = np.zeros(len(own.words) + 1, np.int32)
        starts = own.start[repeated]
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        left_over = np.r_[0, np.cumsum(~gone)][own.bounds]
        words = own.words.filter(pa.array(~gone))
        kept = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(left_over, pa.int64()), words), pa.scalar(b" ", pa.large_binary()))
        sizes = np.diff(own.bounds)
        ids = pa.array([own.ids[i] for i in own.rows], pa.int64())
        return pa.table({"id": ids, "n_words": pa.array(sizes), "n_removed": pa.array(sizes - np.diff(left_over)), "kept_text": kept.cast(pa.binary()).cast(pa.string())})

    return run


def remove_repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 20) -> DataFrame:
    """(id, n_words, n_removed, kept_text): texts without words that an earlier equal window covers.

    A window is `length` consecutive words of one document; windows are judged
    on the input.  `kept_text` joins the kept words by one space.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    size = named.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # Four counters for each window, at five bytes a word.
    bits = max(12, int(max(size * 4 // 5, 1) - 1).bit_length())
    # Beyond 2**14 slices a row they widen (to 2**27 counters of a byte), or a chunk would send near-empty ones.
    slice_bits = min(bits, max(SLICE_COUNTERS.bit_length() - 1, min(27, bits - 14)))
    groups = max(64, size // 5 // 2_000_000)
    chunks = to_chunks(named, ["id", "text"], "text")
    sketches = chunks.mapInArrow(_sketch(length, bits, slice_bits), "slice long, chunk long, body binary")
    answers = sketches.groupBy("slice").applyInArrow(_merge(slice_bits), "chunk long, slice long, body binary")
    found = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_candidates(length, bits, slice_bits, groups), "grp long, chunk long, body binary")
    earlier = found.groupBy("grp").applyInArrow(_exact, "chunk long, body binary")
    return chunks.groupBy("chunk").cogroup(earlier.groupBy("chunk")).applyInArrow(_finish(length), _OUT)


def brute_force(rows: list[tuple[int | None, str | None]], length: int = 20) -> list[tuple]:
    """The same result by a dictionary of windows, for tests."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        words = (rows[i][1] or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((rows[i][0], len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
