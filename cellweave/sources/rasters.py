"""Rasters as a Spark data source, read by windows, and a sink that executors write in parallel.

Reading: a partition is a run of strips or tiles and reads their byte ranges
only; filters on row, col and layer drop blocks before any task starts (Spark
filters the rows of the blocks that are left).  The driver reads a file's
directory, a few hundred bytes, never its arrays of offsets.

Writing: cells are gathered by tile and compressed on the executors; a tile's
place in the file is a prefix sum of the sizes, and tasks write at their places
in one file on a shared POSIX folder.  A task that runs again writes the same
bytes at the same place.  The directory is written last, when all tiles have
been counted, and the file then appears under its name at once.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cellweave.functions.grid import Grid
from cellweave.sinks import checkpointed
from cellweave.sources import geotiff

#: Decoded bytes of blocks that one task reads, about.
RUN_BYTES = 32 << 20
#: Tiles whose places are summed in one window.
TILES = 4096
SCHEMA = "layer string, row long, col long, x double, y double, value double"


def _located(path: str):
    """(file system, path in it) of a local path or a URI that Arrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def local_path(uri: str) -> str:
    """The POSIX path of a path or a file URI."""
    return "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


@contextmanager
def ranged(path: str):
    """A function read(start, size) over a file."""
    store, inner = _located(path)
    with store.open_input_file(inner) as f:
        yield lambda start, size: f.read_at(size, start)


def raster_files(path: str) -> list[str]:
    """The path itself, or the TIFF files below it, in order."""
    from pyarrow import fs

    store, inner = _located(path)
    found = store.get_file_info(inner)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.is_file:
        return [path]
    below = store.get_file_info(fs.FileSelector(inner, recursive=True))
    root = path.rstrip("/")
    return sorted(root + f.path[len(inner.rstrip("/")) :] for f in below if f.is_file and f.extension.lower() in ("tif", "tiff"))


def raster_grid(path: str) -> Grid:
    """The grid of a raster, from its directory alone."""
    with ranged(path) as read:
        return geotiff.layout(geotiff.Directory(read)).grid


def raster_texts(path: str) -> dict[str, str]:
    with ranged(path) as read:
        return geotiff.metadata(geotiff.Directory(read))


@dataclass
class Run(InputPartition):
    """Blocks of one file, as ranges first .. last - 1 of block numbers."""

    path: str
    ranges: list[tuple[int, int]]


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.low = {"row": 0, "col": 0}
        self.high = {"row": 1 << 62, "col": 1 << 62}
        self.layers: set[str] | None = None

    def pushFilters(self, filters):
        """Narrow the window; every filter is left to Spark as well, so blocks at the edge are cut exactly."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.low:
                values = f.value if isinstance(f, In) else [getattr(f, "value", None)]
                if not values or not all(isinstance(v, (int, float)) for v in values):
                    yield f
                    continue
                if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], int(min(values)))
                if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], int(max(values)))
            elif name == "layer" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.layers = wanted if self.layers is None else self.layers & wanted
            yield f

    def partitions(self) -> list[Run]:
        runs = []
        for path in raster_files(self.path):
            if self.layers is not None and PurePosixPath(path).stem not in self.layers:
                continue
            with ranged(path) as read:
                plan = geotiff.layout(geotiff.Directory(read))
            room = max(1, RUN_BYTES // (plan.tall * plan.wide * plan.dtype.itemsize))
            rows = range(max(0, self.low["row"]) // plan.tall, min(plan.down - 1, self.high["row"] // plan.tall) + 1)
            left, right = max(0, self.low["col"]) // plan.wide, min(plan.across - 1, self.high["col"] // plan.wide) + 1
            if left >= right:
                continue
            held, size = [], 0
            for r in rows:
                start = r * plan.across + left
                while start < r * plan.across + right:
                    stop = min(r * plan.across + right, start + room - size)
                    if held and held[-1][1] == start:
                        held[-1] = (held[-1][0], stop)
                    else:
                        held.append((start, stop))
                    size, start = size + stop - start, stop
                    if size == room:
                        runs.append(Run(path, held))
                        held, size = [], 0
            if held:
                runs.append(Run(path, held))
        return runs

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return  # no block is left
        layer = PurePosixPath(partition.path).stem
        with ranged(partition.path) as read:
            tags = geotiff.Directory(read)
            plan = geotiff.layout(tags)
            for first, last in partition.ranges:
                for k, offset, count in zip(range(first, last), tags.part(plan.offsets, first, last), tags.part(plan.counts, first, last)):
                    if count:
                        yield _batch(layer, plan, *plan.values(read(offset, count), k))
                    else:  # a block that was never written
                        row, col = k // plan.across * plan.tall, k % plan.across * plan.wide
                        shape = min(plan.tall, plan.grid.height - row), min(plan.wide, plan.grid.width - col)
                        yield _batch(layer, plan, row, col, np.zeros(shape), np.ones(shape, bool))


def _batch(layer: str, plan: geotiff.Layout, row: int, col: int, values: np.ndarray, missing: np.ndarray) -> pa.RecordBatch:
    grid = plan.grid
    rows, cols = (x.ravel() for x in np.mgrid[row : row + values.shape[0], col : col + values.shape[1]])
    return pa.RecordBatch.from_arrays(
        [pa.array([layer] * len(rows)), pa.array(rows), pa.array(cols), pa.array(grid.origin_x + (cols + 0.5) * grid.size), pa.array(grid.origin_y - (rows + 0.5) * grid.size), pa.array(values.ravel().astype(float), mask=missing.ravel())],
        names=["layer", "row", "col", "x", "y", "value"],
    )


@dataclass
class Written(WriterCommitMessage):
    tiles: int


class TileWriter(DataSourceWriter):
    """Writes rows (tile, at, size, body) into the file that `prepare` has begun."""

    def __init__(self, options: dict):
        self.draft, self.path = options["draft"], options["path"]
        self.tiles, self.head = int(options["tiles"]), int(options["head"])
        self.places = int(options["offsets"]), int(options["counts"])
        self.word = options["word"]
        self.directory = bytes.fromhex(options["directory"])

    def write(self, iterator) -> Written:
        n, size = 0, struct.calcsize("<" + self.word)
        with open(self.draft, "r+b") as f:
            for row in iterator:
                for at, data in ((row["at"], row["body"]), (self.places[0] + row["tile"] * size, struct.pack("<" + self.word, row["at"])), (self.places[1] + row["tile"] * size, struct.pack("<" + self.word, row["size"]))):
                    f.seek(at)
                    f.write(data)
                n += 1
            f.flush()
            os.fsync(f.fileno())
        return Written(n)

    def commit(self, messages) -> None:
        done = sum(m.tiles for m in messages if m is not None)
        if done != self.tiles:
            raise RuntimeError(f"{done} of {self.tiles} tiles were written")
        with open(self.draft, "r+b") as f:
            end = f.seek(0, os.SEEK_END)
            start = -(-max(end, self.head) // 8) * 8
            if start != self.head:
                raise RuntimeError("tiles do not fill the space that they were given")
            f.seek(start)
            f.write(self.directory)
            f.seek(8 if self.word == "Q" else 4)
            f.write(struct.pack("<" + self.word, start))
            f.flush()
            os.fsync(f.fileno())
        os.link(self.draft, self.path)  # fails if the name is taken meanwhile
        os.unlink(self.draft)

    def abort(self, messages) -> None:
        if os.path.exists(self.draft):
            os.unlink(self.draft)


class RasterSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cellweave_raster"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RasterReader:
        return RasterReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def read_rasters(spark: SparkSession, path: str) -> DataFrame:
    """(layer, row, col, x, y, value) of a TIFF file, or of all below a folder; missing values are null.

    Filters on row, col (comparisons with numbers) and layer (equality) decide
    which bytes are read.
    """
    register(spark)
    return spark.read.format(RasterSource.name()).load(path)


def _tiles(cells: DataFrame, grid: Grid, value: str, dtype: np.dtype, no_data: float, tile: int) -> DataFrame:
    """(tile, size, body): compressed tiles that hold a cell; of cells given twice one value stays."""
    across = -(-grid.width // tile)
    inside = (F.col("row") >= 0) & (F.col("row") < grid.height) & (F.col("col") >= 0) & (F.col("col") < grid.width)
    checked = F.when(inside, F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)).otherwise(F.raise_error(F.lit("cell outside the grid")).cast("long"))
    # One row for each cell before tiles are gathered, so a tile's group is bounded.
    named = cells.groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.max(F.col(value).cast("double")).alias("v")).withColumn("tile", checked)

    def fill(key, table):
        out = np.full((tile, tile), float(no_data))
        v = table.column("v").to_numpy(zero_copy_only=False).astype(float)
        out[table.column("row").to_numpy() % tile, table.column("col").to_numpy() % tile] = np.where(np.isnan(v), no_data, v)
        body = zlib.compress(out.astype(dtype).tobytes(), 6)
        return pa.table({"tile": pa.array([key[0].as_py()], pa.int64()), "size": pa.array([len(body)], pa.int64()), "body": pa.array([body], pa.binary())})

    return named.groupBy("tile").applyInArrow(fill, "tile long, size long, body binary")


def write_raster(cells: DataFrame, grid: Grid, value: str, path: str, dtype: str = "<f4", no_data: float = -9999.0, texts: dict[str, str] | None = None, tile: int = 256, big: bool | None = None) -> None:
    """Write a layer of a cell table (row, col, value) as one tiled file on a shared POSIX folder; never over another file.

    Cells that are missing or not given hold `no_data`; a cell outside the grid is an error.
    `texts` are stored with the file.
    """
    path = local_path(path)
    if tile % 16:
        raise ValueError("tiles are multiples of 16 cells")
    if os.path.exists(path):
        raise FileExistsError(path)
    kind = np.dtype(dtype)
    blocks = -(-grid.width // tile) * -(-grid.height // tile)
    packed = checkpointed(_tiles(cells, grid, value, kind, no_data, tile))
    group = F.col("tile") - F.pmod("tile", F.lit(TILES))
    sums = packed.groupBy(group.alias("group")).agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row for each few thousand tiles
    starts = sums.select("group", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("group").orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    placed = packed.withColumn("group", group).withColumn("in", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, "group")
    total = packed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    empty = zlib.compress(np.full(tile * tile, no_data).astype(kind).tobytes(), 6)
    if big is None:
        big = total["bytes"] + 16 * blocks > 3 << 30
    word = "Q" if big else "I"
    size = struct.calcsize("<" + word)
    offsets = 16
    counts = offsets + size * blocks
    shared = counts + size * blocks
    data = shared + len(empty)
    head = -(-(data + total["bytes"]) // 8) * 8
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with open(draft, "xb") as f:
        f.write(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0) + b"\0" * 8))
        for content in (shared, len(empty)):  # tiles without a cell share one
            for start in range(0, blocks, 1 << 16):
                n = min(1 << 16, blocks - start)
                f.write(struct.pack(f"<{n}{word}", *[content] * n))
        f.write(empty)
        f.truncate(head)
    directory = geotiff.directory_bytes(grid, kind, no_data, tile, blocks, (offsets, counts), head, big, texts or {})
    if blocks == 1:  # a single value stands in the directory itself
        at, count = (data, total["bytes"]) if total["n"] else (shared, len(empty))
        directory = geotiff.directory_bytes(grid, kind, no_data, tile, blocks, ([at], [count]), head, big, texts or {})
    register(cells.sparkSession)
    rows = placed.select("tile", (F.col("start") + F.col("in") + data).alias("at"), "size", "body")
    options = {"draft": draft, "tiles": total["n"], "head": head, "offsets": offsets, "counts": counts, "word": word, "directory": directory.hex()}
    rows.write.format(RasterSource.name()).options(**{k: str(v) for k, v in options.items()}).mode("append").save(path)
