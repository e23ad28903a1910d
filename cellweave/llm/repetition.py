"""Quality rules from a suffix array: how much of a text is a repetition of itself.

Texts are cut into words.  Many documents share one suffix array, built by
prefix doubling in NumPy: the first key of a suffix is (document, word), so
suffixes of different documents never share a prefix, and each round sorts only
the suffixes whose rank is still shared.  Longest common prefixes of neighbours
are compared only where the preceding words differ and follow from those
elsewhere.  A stack gives the LCP intervals: each is a repeated word sequence
that is maximal to the right, and maximal to both sides if its occurrences
follow different words.  Memory is linear in the words of a batch.  The spans of all maximal repeats of at least `min_repeat` words are united, and
a document is rejected if they cover too much of it or one of them is too long.

Defined results: null and empty texts have no words and fail the base rules;
ties and repeated rows are judged one by one and alike; an empty table gives an
empty result; a text may be of any length (it is its own batch); further
columns are neither read nor, by `judge`, returned, and `filter_documents`
returns every column of its input unchanged, whatever its name.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm._base import as_bytes, slices
from cellweave.llm._words import codes, split_all

#: Text bytes that share a suffix array.
BATCH_BYTES = 4 << 20
#: Word pairs that are compared at once.
COMPARED = 1 << 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


@dataclass(frozen=True)
class Limits:
    """Base limits (words, repeated three-word windows) and the limits on maximal repeats."""

    min_words: int = 50
    window: int = 3
    max_window_share: float = 0.5
    min_repeat: int = 8
    max_covered: float = 0.3
    max_repeat: int = 100


def _suffixes(number: np.ndarray, owner: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All suffixes in ascending order, those of one document together; prefix doubling."""
    n = len(number)
    key = owner.astype(np.int64) * (int(number.max()) + 1) + number
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    head = np.r_[True, ranked[1:] != ranked[:-1]]
    # A suffix's rank is the position of the first suffix that has the same prefix.
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    step = 1
    active = np.flatnonzero(~(head & np.r_[head[1:], True]))  # positions in the order whose rank is shared
    while len(active):
        suffix = order[active]
        ahead = suffix + step
        after = np.where(ahead < last[suffix], rank[np.minimum(ahead, n - 1)] + 1, 0)
        group = rank[suffix]
        sort = np.lexsort((after, group))
        suffix, after, group = suffix[sort], after[sort], group[sort]
        order[active] = suffix
        head = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        rank[suffix] = active[np.flatnonzero(head)[np.cumsum(head) - 1]]
        step *= 2
        active = active[~(head & np.r_[head[1:], True])]
    return order


def _common(number: np.ndarray, last: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes a[i] and b[i] share, compared in blocks of bounded size."""
    length = np.zeros(len(a), np.int64)
    live, width, top = np.arange(len(a)), 4, len(number) - 1
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        room = np.minimum(last[a[live]] - x, last[b[live]] - y)
        ahead = np.arange(max(1, min(width, int(room.max()))))
        same = number[np.minimum(x[:, None] + ahead, top)] == number[np.minimum(y[:, None] + ahead, top)]
        same &= ahead < room[:, None]
        run = np.where(same.all(axis=1), len(ahead), same.argmin(axis=1))
        length[live] += run
        live = live[run == len(ahead)]
        width = max(1, min(2 * width, COMPARED // max(1, len(live))))
    return length


def _neighbours(number: np.ndarray, owner: np.ndarray, last: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each position of the order, the words that its suffix shares with the one before it.

    If the words before two neighbours are equal, the suffixes that begin with
    them are neighbours too and share one word more.  Only the others are
    compared; their common lengths add up to n log n at most.
    """
    at = np.arange(len(number))
    before = np.full(len(number), -1)
    before[order[1:]] = order[:-1]
    first = np.r_[True, owner[1:] != owner[:-1]]
    linked = (before >= 0) & (owner[before] == owner)
    follows = linked & ~first & ~first[before]
    follows[follows] = number[at[follows] - 1] == number[before[follows] - 1]
    value = np.zeros(len(number), np.int64)
    compared = np.flatnonzero(linked & ~follows)
    value[compared] = _common(number, last, compared, before[compared])
    source = np.maximum.accumulate(np.where(follows, 0, at))
    return (value[source] - (at - source))[order]


def _intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """LCP intervals of `least` words or more: (length, first, last, parent or -1, positions, interval of each position).

    A position p stands for the neighbours p - 1 and p; the interval given for
    it is the innermost one that holds both.
    """
    length, left, right, parent, home = (array("q") for _ in range(5))
    stack: list[int] = []
    positions = np.flatnonzero(lcp >= least)

    def close(until: int, value: int) -> tuple[int, int]:
        """Close the intervals longer than `value`: the last one closed (or -1), and where it begins."""
        child, begin = -1, until
        while stack and length[stack[-1]] > value:
            top = stack.pop()
            if child >= 0:
                parent[child] = top
            right[top], child, begin = until, top, left[top]
        return child, begin

    previous = -2
    for a in range(0, len(positions), 1 << 16):
        part = positions[a : a + (1 << 16)]
        for p, value in zip(part.tolist(), lcp[part].tolist()):
            if p != previous + 1:
                close(previous, 0)
            child, begin = close(p - 1, value)
            if not stack or length[stack[-1]] < value:
                stack.append(len(length))
                length.append(value), left.append(begin), right.append(-1), parent.append(-1)
            if child >= 0:
                parent[child] = stack[-1]
            home.append(stack[-1])
            previous = p
    close(previous, 0)
    return (*(np.array(v, np.int64) for v in (length, left, right, parent)), positions, np.array(home, np.int64))


@dataclass
class Repeats:
    """`longest`: for each word the length of the longest repeated sequence that starts there (0: none).

    `maximal` and `maximal_owner`: length and document of each maximal repeat, a
    word sequence found twice or more that cannot be extended to either side
    without losing an occurrence.  `starts`, `lengths`: for each word at which a
    maximal repeat occurs, the longest that does.
    """

    longest: np.ndarray
    maximal: np.ndarray
    maximal_owner: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def find_repeats(number: np.ndarray, owner: np.ndarray, least: int) -> Repeats:
    """Repeats of `least` words or more; `number` are word codes, `owner` the ascending number of the document."""
    n = len(number)
    if not n:
        return Repeats(*(np.empty(0, np.int64) for _ in range(5)))
    last = np.searchsorted(owner, owner, side="right")  # end of the own document
    order = _suffixes(number, owner, last)
    lcp = _neighbours(number, owner, last, order)
    longest = np.empty(n, np.int64)
    longest[order] = np.maximum(lcp, np.r_[lcp[1:], 0])
    length, left, right, parent, positions, home = _intervals(lcp, max(1, least))
    if not len(length):
        return Repeats(longest, *(np.empty(0, np.int64) for _ in range(4)))
    # An interval is maximal to the left if two of its suffixes follow different words; the start of a document is one of its own.
    preceding = np.r_[-1, number[:-1]].astype(np.int64)
    preceding[np.r_[True, owner[1:] != owner[:-1]]] = -1
    preceding = preceding[order]
    changes = np.r_[0, np.cumsum(preceding[1:] != preceding[:-1])]
    diverse = changes[right] > changes[left]
    # The longest maximal repeat around each interval: itself, or that of its parent, which is shorter and so comes first.
    around = np.where(diverse, length, 0)
    outward = np.argsort(length, kind="stable")
    for i in outward[~diverse[outward]].tolist():
        around[i] = around[parent[i]] if parent[i] >= 0 else 0
    best = np.zeros(n + 1, np.int64)
    best[positions] = around[home]
    spans = np.zeros(n, np.int64)
    spans[order] = np.maximum(best[:-1], best[1:])
    starts = np.flatnonzero(spans)
    return Repeats(longest, length[diverse], owner[order[left[diverse]]], starts, spans[starts])


def covered(n: int, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Whether each of n words lies in one of the spans starts[i] .. starts[i] + length[i] - 1."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + length, -1)
    return np.cumsum(change[:-1]) > 0


def measure(texts: list, limits: Limits = Limits()) -> dict[str, np.ndarray]:
    """All figures and verdicts for UTF-8 texts (None: no words)."""
    words, bounds = split_all(texts)
    number, _ = codes(words)
    n = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), n)
    repeats = find_repeats(number, owner, limits.min_repeat)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return sums[bounds[1:]] - sums[bounds[:-1]]

    windows = np.flatnonzero(repeats.longest >= limits.window)
    in_repeat = covered(len(number), repeats.starts, repeats.lengths)
    chars, symbols, lines = (np.zeros(len(texts), np.int64) for _ in range(3))
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = np.frombuffer(text, np.uint8)
        # Code points: bytes that do not continue one; white space of the word definition is not counted.
        chars[i] = np.count_nonzero(((raw & 0xC0) != 0x80) & (raw != 32) & ((raw < 9) | (raw > 13)))
        symbols[i] = np.count_nonzero(_SYMBOLS[raw])
        parts = [p for p in text.split(b"\n") if _WORD.search(p)]
        lines[i] = len(parts) - len(set(parts))
    repeat_words = total(covered(len(number), windows, limits.window))
    repeated = total(in_repeat)
    longest_repeat = np.zeros(len(texts), np.int64)
    np.maximum.at(longest_repeat, repeats.maximal_owner, repeats.maximal)
    base_failed = (n < limits.min_words) | (repeat_words > limits.max_window_share * n)
    rejected = (repeated > limits.max_covered * n) | (longest_repeat > limits.max_repeat)
    maximal = np.zeros(len(texts), np.int64)
    np.add.at(maximal, repeats.maximal_owner, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat_words,
        "base_failed": base_failed, "kept": ~(base_failed | rejected),
        "n_maximal_repeats": maximal, "n_covered_words": repeated, "longest_repeat": longest_repeat,
    }


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_maximal_repeats long, n_covered_words long, longest_repeat long"


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """(id, figures, base_failed, kept): one row for each document, without a shuffle."""

    def run(batches):
        for table in slices(batches, "text", BATCH_BYTES):
            found = measure(as_bytes(table.column("text").combine_chunks()), limits)
            ids = table.column("id").combine_chunks()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in found.values())], names=["id", *found])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id long, {_FIGURES}")


def filter_documents(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The documents that the rules keep, with all of their columns."""

    def run(batches):
        for table in slices(batches, text, BATCH_BYTES):
            kept = measure(as_bytes(table.column(text).combine_chunks()), limits)["kept"]
            yield from table.filter(pa.array(kept)).to_batches()

    return docs.mapInArrow(run, docs.schema)
