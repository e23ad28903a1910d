"""Words as the contracts define them: runs of bytes other than ASCII white space.

``bytes.split()`` without arguments splits exactly at 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Every white space byte as a space.
TO_SPACE = bytes(32 if b in b"\t\n\r\x0b\x0c" else b for b in range(256))


def split_all(texts: list) -> tuple[list, np.ndarray]:
    """All words of the texts in one list, and where each text's words start (one entry more than texts)."""
    words: list = []
    bounds = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        if text:
            words += text.split()
        bounds[i + 1] = len(words)
    return words, bounds


def codes(words: list) -> tuple[np.ndarray, list]:
    """A number for each word, and the distinct words in order of number."""
    if not words:
        return np.empty(0, np.int32), []
    coded = pa.array(words, pa.large_binary()).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def split_columns(texts: list) -> tuple[pa.Array, np.ndarray]:
    """As `split_all`, but the words are one Arrow column; no Python object is made for a word."""
    plain = [text.translate(TO_SPACE) if text else b"" for text in texts]
    parts = pc.split_pattern(pa.array(plain, pa.large_binary()), b" ")
    words = parts.flatten()
    some = pc.greater(pc.binary_length(words), 0)
    count = np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))]
    return words.filter(some), count[parts.offsets.to_numpy()] if len(texts) else np.zeros(1, np.int64)


def word_lanes(distinct: list) -> np.ndarray:
    """Two independent 64-bit values for each distinct word (its XXH3 of 128 bits)."""
    if not distinct:
        return np.empty((0, 2), np.uint64)
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), np.uint64).reshape(-1, 2)


#: Odd multipliers of the two window-hash lanes.
LANES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def window_hashes(values: np.ndarray, length: int, multiplier: int) -> np.ndarray:
    """Polynomial hash of every `length` consecutive values, by doubling.

    The values are uniform 64-bit hashes, so two different windows agree in a
    lane with a probability near 2**-64.
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        power = {1: values}
        step = 1
        while step * 2 <= length:
            half = power[step]
            factor = np.uint64(pow(multiplier, step, 1 << 64))
            power[step * 2] = half[: len(half) - step] + factor * half[step:]
            step *= 2
        out, done = None, 0
        for size in sorted(power, reverse=True):
            if length - done >= size:
                part = power[size][done : done + n]
                out = part.copy() if out is None else out + np.uint64(pow(multiplier, done, 1 << 64)) * part
                done += size
    return out
