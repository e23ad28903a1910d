"""Flat token-id files with 64-bit document offsets.

A folder holds one set of files for each shard, shards in ascending id order:

    shard-00000.tokens    all ids, little-endian unsigned 16- or 32-bit integers, nothing else
    shard-00000.offsets   unsigned 64-bit: where each document starts in the shard's ids, and the end
    shard-00000.ids       signed 64-bit document ids (NULL_ID for null)
    manifest.json         item size and, for each shard, documents, ids and the base of its ids

Documents are range-partitioned and sorted by id; every task streams its shard
to files of its own and renames them when they are complete, so a task may run
again or twice.  A shard's base is the sum of the ids before it: the driver
adds up one number for each shard.  Readers map a shard's files into memory.

Defined results: a null text counts as empty and an empty one is its end id;
null ids come first; rows with equal ids are ordered by a hash of their text and the
text, and equal rows are written each; an empty table gives shards without documents; a text
may be of any length up to a worker's memory; further columns are not read.
"""

from __future__ import annotations

import json
import math
import os
import uuid
import zlib
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm._base import as_bytes, input_bytes, slices
from cellweave.llm.tokens import encoder

NULL_ID = np.iinfo(np.int64).min
#: Input bytes (as the plan estimates them) for each shard.
SHARD_BYTES = 16 << 20
#: Text bytes that are encoded together, and cached pieces of a worker.
SLICE_BYTES = 6 << 20
CACHE = 400_000


class Folder:
    """A shared folder by URI: POSIX paths directly (and mapped), other stores by pyarrow's file systems."""

    def __init__(self, uri: str):
        parts = urlparse(uri)
        self.local = parts.scheme in ("", "file")
        if self.local:
            self.fs, self.path = None, unquote(parts.path)
        else:
            from pyarrow import fs

            self.fs, self.path = fs.FileSystem.from_uri(uri)

    def make(self) -> None:
        if self.local:
            os.makedirs(self.path, exist_ok=True)
        else:
            self.fs.create_dir(self.path, recursive=True)

    def create(self, name: str):
        """A stream to a temporary name; give it to `publish` when it is complete."""
        temporary = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        return temporary, open(temporary, "wb") if self.local else self.fs.open_output_stream(temporary)

    def publish(self, temporary: str, name: str) -> None:
        if self.local:
            os.replace(temporary, f"{self.path}/{name}")
        else:
            self.fs.move(temporary, f"{self.path}/{name}")

    def array(self, name: str, dtype) -> np.ndarray:
        """A file as an array: mapped on a POSIX path, else read."""
        if not self.local:
            with self.fs.open_input_file(f"{self.path}/{name}") as f:
                return np.frombuffer(f.read(), dtype)
        path = f"{self.path}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)

    def delete(self) -> None:
        if self.local:
            import shutil

            shutil.rmtree(self.path, ignore_errors=True)
        else:
            self.fs.delete_dir(self.path)


def write(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text", end: int = 1) -> dict:
    """Write the files and return the manifest."""
    from tokenizers import Tokenizer

    item = "<u2" if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
    named = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    shards = max(docs.sparkSession.sparkContext.defaultParallelism, math.ceil(input_bytes(named) / SHARD_BYTES))
    Folder(folder).make()

    def run(batches):
        from pyspark import TaskContext

        number, store, tool = TaskContext.get().partitionId(), Folder(folder), encoder(tokenizer, CACHE)
        names = [f"shard-{number:05d}.{k}" for k in ("tokens", "offsets", "ids")]
        opened = [store.create(n) for n in names]
        total = count = 0
        opened[1][1].write(np.zeros(1, "<u8").tobytes())
        for table in slices(batches, "text", SLICE_BYTES):
            ids, bounds = tool.encode(as_bytes(table.column("text").combine_chunks()), end)
            opened[0][1].write(ids.astype(item).tobytes())
            opened[1][1].write((bounds[1:] + total).astype("<u8").tobytes())
            opened[2][1].write(table.column("id").combine_chunks().fill_null(NULL_ID).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
            total, count = total + int(bounds[-1]), count + table.num_rows
        for (temporary, stream), name in zip(opened, names):
            stream.close()
            store.publish(temporary, name)
        yield pa.RecordBatch.from_pydict({"shard": [number], "documents": [count], "tokens": [total]})

    # The hash lets rows of one id (or none) fall in several shards, and keeps whole texts out of the range bounds.
    spread = named.withColumn("hash", F.xxhash64("text"))
    ordered = spread.repartitionByRange(shards, "id", "hash").sortWithinPartitions("id", "hash", "text")
    rows = sorted(ordered.select("id", "text").mapInArrow(run, "shard long, documents long, tokens long").collect())
    bases = np.cumsum([0, *(r.tokens for r in rows)]).tolist()
    manifest = {"item": item, "shards": [{"shard": r.shard, "documents": r.documents, "tokens": r.tokens, "base": b} for r, b in zip(rows, bases)]}
    store = Folder(folder)
    temporary, stream = store.create("manifest.json")
    stream.write(json.dumps(manifest).encode())
    stream.close()
    store.publish(temporary, "manifest.json")
    return manifest


def manifest_of(folder: str) -> dict:
    return json.loads(bytes(Folder(folder).array("manifest.json", np.uint8)))


class Shard:
    """A shard's files, mapped; documents by position."""

    def __init__(self, folder: str, shard: int, item: str):
        store, name = Folder(folder), f"shard-{shard:05d}"
        self.tokens = store.array(f"{name}.tokens", np.dtype(item))
        self.offsets = store.array(f"{name}.offsets", np.dtype("<u8"))
        self.ids = store.array(f"{name}.ids", np.dtype("<i8"))

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.tokens[int(self.offsets[i]) : int(self.offsets[i + 1])]


def read(spark: SparkSession, folder: str, batch: int = 5_000) -> DataFrame:
    """(id, start, n_tokens, ids): every document, from the files; `ids` as little-endian unsigned 32-bit integers."""
    manifest = manifest_of(folder)
    item = manifest["item"]
    rows = [(s["shard"], s["base"]) for s in manifest["shards"]]
    numbers = spark.createDataFrame(rows, "shard long, base long").repartition(max(1, len(rows)))

    def run(batches):
        for got in batches:
            for number, base in zip(got.column("shard").to_pylist(), got.column("base").to_pylist()):
                shard = Shard(folder, number, item)
                size, first = 0, 0
                for i in range(len(shard) + 1):
                    if i == len(shard) or i - first >= batch or size >= 8 << 20:
                        offsets = np.asarray(shard.offsets[first : i + 1]).astype(np.int64)
                        ids = pa.array([None if d == NULL_ID else int(d) for d in shard.ids[first:i]], pa.int64())
                        bodies = pa.array([shard[k].astype("<u4").tobytes() for k in range(first, i)], pa.binary())
                        yield pa.RecordBatch.from_arrays([ids, pa.array(offsets[:-1] + base), pa.array(np.diff(offsets)), bodies], names=["id", "start", "n_tokens", "ids"])
                        size, first = 0, i
                    if i < len(shard):
                        size += 4 * int(shard.offsets[i + 1] - shard.offsets[i])

    return numbers.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
