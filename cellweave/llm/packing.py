"""Best-fit decreasing packing of token sequences.

A document longer than the window is first cut into full windows and a rest.
Rests are placed from the longest to the shortest, each into the open sequence
with the least room that still takes it, which a segment tree over remaining
capacity finds in a logarithmic number of steps.  Each partition packs its own
documents in blocks of bounded size, without a shuffle; sequences that a block
leaves badly filled are opened again in the partition's next one.

Defined results: a null text counts as empty, and an empty one is its end id;
a text of any length is cut into windows; ties go to the earlier document and
repeated rows are packed as separate documents; a null id is returned as null;
an empty table gives an empty result; further columns are neither read nor
returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._base import as_bytes, input_bytes, slices
from cellweave.llm.tokens import CACHE, encoder

#: Input bytes (as the plan estimates them) for which a partition is opened, and tokens that a block packs.
PARTITION_BYTES = 16 << 20
BLOCK_TOKENS = 6_000_000
#: A sequence that is filled less than this may be opened again in the next block.
WELL_FILLED = 0.98


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree of counts."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, change: int) -> None:
        i = self.leaves + room
        while i:
            self.count[i] += change
            i >>= 1

    def push(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def tightest(self, length: int) -> int | None:
        """The least room of `length` or more that is open."""
        i = self.leaves + length
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves

    def take(self, length: int) -> tuple[int, int] | None:
        room = self.tightest(length)
        if room is None:
            return None
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Sequences of at most `window`, as lists of positions in `lengths`."""
    sequences: list[list[int]] = []
    state = OpenSequences(window)
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        got = state.take(length)
        if got is None:
            sequences.append([i])
            room, number = window - length, len(sequences) - 1
        else:
            sequences[got[1]].append(i)
            room, number = got[0] - length, got[1]
        if room:
            state.push(room, number)
    return sequences


_OUT = "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """Packs one partition's pieces and gives them out as record batches."""

    def __init__(self, window: int, partition: int):
        self.window, self.next = window, partition << 40
        self.pieces: list[tuple] = []  # id, start, ids, doc_tokens
        self.held = 0
        self.rows: list[tuple] = []

    def document(self, doc_id, ids: np.ndarray) -> None:
        for start in range(0, len(ids), self.window):
            piece = (doc_id, start, ids[start : start + self.window], len(ids))
            if len(piece[2]) == self.window:
                self._emit([piece])
            else:
                self.pieces.append(piece)
                self.held += len(piece[2])

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), ids.astype("<u4").tobytes(), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def block(self, last: bool) -> None:
        pieces, self.pieces, self.held = self.pieces, [], 0
        for members in best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), self.window):
            mine = [pieces[i] for i in members]
            filled = sum(len(p[2]) for p in mine)
            if last or filled >= WELL_FILLED * self.window:
                self._emit(mine)
            else:
                self.pieces += [(p[0], p[1], p[2].copy(), p[3]) for p in mine]
                self.held += filled

    def take(self) -> Iterator[pa.RecordBatch]:
        """What is ready, in batches of about a million ids."""
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        step = max(1, (1 << 20) // self.window)
        for a in range(0, len(self.rows), step):
            columns = zip(*self.rows[a : a + step])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
        self.rows = []


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = 2048, end: int = 1, slice_bytes: int = 6 << 20, cache: int = CACHE) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all sequences.

    `tokenizer` is the path of a `tokenizers` file; `ids` are little-endian
    unsigned 32-bit integers; each document ends with the id `end`.  `slice_bytes`
    of text and `cache` pieces bound a worker's memory; a block ends with a slice, so
    `slice_bytes` decides which documents may share a sequence, but no document's ids.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    wanted = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(input_bytes(named) / PARTITION_BYTES))

    def run(batches):
        from pyspark import TaskContext

        packer = _Packer(window, TaskContext.get().partitionId())
        tool = encoder(tokenizer, cache)
        for table in slices(batches, "text", slice_bytes):
            ids, bounds = tool.encode(as_bytes(table.column("text").combine_chunks()), end)
            for i, name in enumerate(table.column("id").to_pylist()):
                packer.document(name, ids[bounds[i] : bounds[i + 1]])
            if packer.held >= BLOCK_TOKENS:
                packer.block(False)
            yield from packer.take()
        packer.block(True)
        yield from packer.take()

    return named.coalesce(wanted).mapInArrow(run, _OUT)
