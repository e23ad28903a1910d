"""Shared plumbing: checkpoints, chunking of texts, compact array blobs.

Documents travel between stages as *chunks*: one row per few megabytes of
text, holding an Arrow IPC stream compressed with zstd.  A chunk is the unit of
work for the vectorised passes; its size bounds a Python worker's memory, and a
few hundred bytes of row overhead are paid per chunk instead of per document.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one chunk holds at most (a longer single text is a chunk of its own).
CHUNK_BYTES = 6 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (as in tests) a
    temporary folder is made and set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="cellweave-"))
    return named or sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written in the shared folder; for loops.

    A checkpoint carries the plan's size estimate on, and a join multiplies the
    estimates of its sides: over k rounds of self-joins the number's length, and
    with it every planning step, grows as 2**k.  A written table has its own size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """Catalyst's size estimate of a plan (file bytes for a scan), without a job.

    A plan that has no estimate, such as rows made by the driver, is measured.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 56:
        return size
    from pyspark.sql import functions as F

    return int(df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0)


def as_bytes(column: pa.Array) -> list:
    """UTF-8 bytes (or None) of a string column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.string()).cast(pa.binary()).to_pylist()


def text_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0)
    return lengths.to_numpy(zero_copy_only=False).astype(np.int64)


def trim() -> None:
    """Give freed Arrow memory back; two workers share an executor with its JVM."""
    pa.default_memory_pool().release_unused()


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Regroup record batches into tables of about `limit` text bytes each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(text_lengths(batch.column(batch.schema.get_field_index(text))))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
            held.append(batch.slice(start, stop - start))
            size += int(ends[stop - 1] - before)
            start = stop
            if size >= limit or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                trim()
    if held:
        yield pa.Table.from_batches(held)


def pack_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack_table(body: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.BufferReader(body)).read_all()


def pack_arrays(**arrays: np.ndarray) -> bytes:
    """Named one-dimensional arrays, which may differ in length, as one zstd blob."""
    names = list(arrays)
    table = pa.RecordBatch.from_arrays(
        [pa.array([arrays[n].tobytes()], pa.large_binary()) for n in names],
        schema=pa.schema([pa.field(n, pa.large_binary(), metadata={"t": arrays[n].dtype.str}) for n in names]),
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 1))) as out:
        out.write_batch(table)
    return sink.getvalue().to_pybytes()


def unpack_arrays(body: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(pa.BufferReader(body)).read_all()
    return {
        f.name: np.frombuffer(table.column(f.name)[0].as_py(), dtype=np.dtype(f.metadata[b"t"].decode()))
        for f in table.schema
    }


def narrow(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    for kind in (np.uint8, np.uint16, np.uint32):
        if top <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.uint64)


def deltas(ascending: np.ndarray) -> np.ndarray:
    """Differences of an ascending sequence (the first to 0), narrowed."""
    return narrow(np.diff(ascending.astype(np.uint64), prepend=np.uint64(0)))


def undelta(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences.astype(np.uint64), dtype=np.uint64)


def to_chunks(docs: DataFrame, columns: list[str], text: str, limit: int = CHUNK_BYTES, gather: bool = False) -> DataFrame:
    """(chunk, body): whole documents grouped into blobs, dealt by chunk number.

    `gather` reads small input partitions together until each holds about a
    chunk (or there is one for each core), without a shuffle.

    Numbers come from the partition and the position in it, so a task that
    runs again makes the same chunks.  Consumers that read the frame more than
    once in one query share its exchange.
    """
    shared_dir(docs.sparkSession)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for k, table in enumerate(slices(batches, text, limit)):
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([base + k], pa.int64()), "body": pa.array([pack_table(table)], pa.binary())})

    named = docs.select(*columns)
    if gather:
        named = named.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(named, text) * 2 // limit)))
    return named.mapInArrow(group, "chunk long, body binary").repartition("chunk")


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64) over unsigned integers."""
    with np.errstate(over="ignore"):
        x = values.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i] + counts[i] - 1."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(counts)
    shift = starts - (ends - counts)
    kind = np.int32 if max(total, int(ends[-1]), int(starts.max()) + int(counts.max())) < 1 << 31 else np.int64
    out = np.repeat(shift.astype(kind), counts)
    out += np.arange(total, dtype=kind)
    return out


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
