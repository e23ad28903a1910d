"""Bloom filter cascade: exact membership over a complete key universe.

The first filter encodes the listed keys; the second the other keys of the
universe that the first wrongly passes; the third the listed keys that the
second passes; and so on until a level passes nothing wrong.  A key of the
universe is decided by the first level that rejects it, without a stored key
and without a join.

Keys are dealt to shards of bounded size by hash; one task builds a shard's
whole cascade from the shard's part of the universe.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm._base import checkpointed, mixed, pack_arrays, unpack_arrays

#: Keys of a shard, about; bytes of all cascades up to which they are broadcast.
SHARD_KEYS = 1_000_000
BROADCAST_BYTES = 32 << 20
#: Distinct keys that one task judges against a shard's cascade beyond that, about.
KEYS_AT_ONCE = 500_000


def _places(h: np.ndarray, g: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    """Bit positions (hashes, keys) of one level's filter, by double hashing."""
    a, b = mixed(h, level), mixed(g, level + 1000) | np.uint64(1)
    with np.errstate(over="ignore"):
        steps = np.arange(hashes, dtype=np.uint64)[:, None]
        return ((a + steps * b) >> np.uint64(1)) % np.uint64(bits)


class Cascade:
    """The levels of one shard: (bit array, bits, hash functions)."""

    def __init__(self, levels: list[tuple[np.ndarray, int, int]]):
        self.levels = levels

    @classmethod
    def build(cls, h: np.ndarray, g: np.ndarray, listed: np.ndarray) -> Cascade:
        """`h` and `g` are two 64-bit hashes of each distinct key of the universe."""
        levels: list[tuple[np.ndarray, int, int]] = []
        inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
        # Balanced first level: about as many false positives as half the listed keys.
        rate = min(0.5, max(1e-9, len(inside) * math.sqrt(0.5) / max(1, len(outside))))
        while len(inside):
            if len(levels) >= 256:
                raise ValueError("two different keys have the same 128-bit hash")
            bits = max(64, math.ceil(len(inside) * math.log(1 / rate) / math.log(2) ** 2))
            hashes = max(1, round(math.log2(1 / rate)))
            array = np.zeros(bits, bool)
            array[_places(h[inside], g[inside], len(levels), bits, hashes).ravel().astype(np.int64)] = True
            levels.append((np.packbits(array), bits, hashes))
            wrong = outside[array[_places(h[outside], g[outside], len(levels) - 1, bits, hashes).astype(np.int64)].all(axis=0)] if len(outside) else outside
            inside, outside, rate = wrong, inside, 0.5
        return cls(levels)

    def listed(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Whether each key of the universe is listed."""
        out = np.zeros(len(h), bool)
        live = np.arange(len(h))
        for level, (packed, bits, hashes) in enumerate(self.levels):
            places = _places(h[live], g[live], level, bits, hashes)
            passed = ((packed[places >> np.uint64(3)] >> (7 - (places & np.uint64(7)).astype(np.uint8))) & 1).astype(bool).all(axis=0)
            out[live[~passed]] = level % 2 == 1
            live = live[passed]
        out[live] = len(self.levels) % 2 == 1
        return out

    def dump(self) -> bytes:
        shape = np.array([[b, k] for _, b, k in self.levels], np.int64).reshape(-1)
        return pack_arrays(shape=shape, **{f"l{i}": a for i, (a, _, _) in enumerate(self.levels)})

    @classmethod
    def load(cls, body: bytes) -> Cascade:
        got = unpack_arrays(body)
        shape = got["shape"].reshape(-1, 2).tolist()
        return cls([(got[f"l{i}"], b, k) for i, (b, k) in enumerate(shape)])


def hashes(key: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string key."""
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def build(universe: DataFrame, key: str = "key", listed: str = "listed") -> tuple[DataFrame, int]:
    """(shard, body) of the cascades, and the number of shards, from distinct keys and a flag."""
    h, g = hashes(F.col(key))
    keys = checkpointed(universe.select(h.alias("h"), g.alias("g"), F.col(listed).alias("listed")))
    shards = max(16, -(-keys.count() // SHARD_KEYS))

    def make(number, table):
        table = table.combine_chunks()
        made = Cascade.build(table.column("h").to_numpy().view(np.uint64), table.column("g").to_numpy().view(np.uint64), table.column("listed").to_numpy(zero_copy_only=False).astype(bool))
        return pa.table({"shard": [number[0].as_py()], "body": pa.array([made.dump()], pa.binary())})

    cascades = keys.groupBy(F.pmod("h", F.lit(shards)).alias("shard")).applyInArrow(make, "shard long, body binary")
    return checkpointed(cascades), shards


def _judge(cascades: dict[int, Cascade], shards: int, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h), bool)
    shard = np.mod(h, shards)
    for s in np.unique(shard):
        here = shard == s
        if int(s) in cascades:
            out[here] = cascades[int(s)].listed(h[here].view(np.uint64), g[here].view(np.uint64))
    return out


def mark(rows: DataFrame, key: str, cascades: DataFrame, shards: int, name: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The rows with a boolean column `name`: is the key listed?

    The cascades are broadcast while they are small together; beyond `limit`
    distinct keys meet their shard's cascade in salted groups and are joined back.
    """
    spark = rows.sparkSession
    h, g = hashes(F.col(key))
    hashed = rows.withColumns({"__h": h, "__g": g})
    size = cascades.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{name}` boolean"
    names = rows.columns

    def finish(table, loaded):
        flags = _judge(loaded, shards, table.column("__h").to_numpy(), table.column("__g").to_numpy())
        return pa.table([*(table.column(n) for n in names), pa.array(flags)], names=[*names, name])

    if size <= limit:
        bodies = spark.sparkContext.broadcast({r["shard"]: bytes(r["body"]) for r in cascades.collect()})

        def scan(batches):
            loaded = {s: Cascade.load(b) for s, b in bodies.value.items()}
            for batch in batches:
                yield from finish(pa.Table.from_batches([batch]).combine_chunks(), loaded).to_batches()

        return hashed.mapInArrow(scan, schema)

    # Distinct keys are dealt by their hashes, so that groups are bounded and a task that runs again deals alike.
    keys = checkpointed(hashed.select("__h", "__g").distinct())
    salts = max(1, -(-keys.count() // (shards * KEYS_AT_ONCE)))
    dealt = keys.withColumns({"__shard": F.pmod("__h", F.lit(shards)), "__salt": F.pmod("__g", F.lit(salts))})
    copies = cascades.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))

    def meet(left, right):
        loaded = {s: Cascade.load(b) for s, b in zip(right.column("shard").to_pylist(), right.column("body").to_pylist())}
        left = left.combine_chunks()
        h, g = left.column("__h"), left.column("__g")
        return pa.table({"h": h, "g": g, "flag": pa.array(_judge(loaded, shards, h.to_numpy(), g.to_numpy()))})

    judged = dealt.groupBy("__shard", "__salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(meet, "h long, g long, flag boolean")
    verdicts = judged.select(F.col("h").alias("__h"), F.col("g").alias("__g"), F.col("flag").alias("__flag"))
    return hashed.join(verdicts, ["__h", "__g"]).select(*(F.col(f"`{c}`") for c in names), F.col("__flag").alias(name))
