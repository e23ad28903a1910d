"""Convolution of gridded values with kernels of any reach, by tiles with halos.

Values are added up by cell, dealt to square tiles, and those within the
kernel's reach of a border are copied to the neighbours (a tile is at least
twice the reach wide, so a cell is copied three times at most, and about once on
average).  Each tile is convolved by FFT, whose cost hardly grows with the
reach, and gives exactly its own cells, so nothing is added up afterwards.

A tile's task holds the tile and its halo, whatever the grid's size.  Beyond the
values given there are zeros; cells that no value reaches have exactly zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a tile's side at least.
TILE = 256


def side(reach: int, tile: int = TILE) -> int:
    return max(tile, 2 * reach, 1)


def _tile(axis: str, size: int, shift: int = 0) -> Column:
    return F.floor((F.col(axis) + shift) / size).cast("long")


def with_halo(values: DataFrame, size: int, reach: int) -> DataFrame:
    """The rows with `tile_row` and `tile_col`, once for each tile whose cells they reach."""
    copies = values.withColumn("tile_row", F.explode(F.sequence(_tile("row", size, -reach), _tile("row", size, reach))))
    return copies.withColumn("tile_col", F.explode(F.sequence(_tile("col", size, -reach), _tile("col", size, reach))))


def tile_sums(block: np.ndarray, kernel: np.ndarray, size: int, reach: int) -> np.ndarray:
    """The convolution on a tile's own cells; `block` has a border of `reach` cells around them, the kernel at most that."""
    r = kernel.shape[0] // 2
    shape = [block.shape[0] + 2 * r] * 2
    whole = np.fft.irfft2(np.fft.rfft2(block, shape) * np.fft.rfft2(kernel, shape), shape)
    out = whole[reach + r : reach + r + size, reach + r : reach + r + size]
    # Round-off of the transform: none where nothing is in reach, none below zero where nothing is negative.
    box = np.pad((block != 0).astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    top, bottom = np.arange(size) + reach - r, np.arange(size) + reach + r + 1
    near = box[np.ix_(bottom, bottom)] - box[np.ix_(top, bottom)] - box[np.ix_(bottom, top)] + box[np.ix_(top, top)]
    out = np.where(near > 0, out, 0.0)
    return np.maximum(out, 0.0) if (block >= 0).all() and (kernel >= 0).all() else out


def reached(block: np.ndarray, r: int, size: int, reach: int) -> np.ndarray:
    """Own cells within r rows and columns of a cell that is set."""
    box = np.pad(block.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    top, bottom = np.arange(size) + reach - r, np.arange(size) + reach + r + 1
    return box[np.ix_(bottom, bottom)] - box[np.ix_(top, bottom)] - box[np.ix_(bottom, top)] + box[np.ix_(top, top)] > 0


def _block(table: pa.Table, value: str, size: int, reach: int, tile: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(values, cells that are given) of a tile with its border."""
    rows = table.column("row").to_numpy() - tile[0] * size + reach
    cols = table.column("col").to_numpy() - tile[1] * size + reach
    block, given = np.zeros((size + 2 * reach,) * 2), np.zeros((size + 2 * reach,) * 2, bool)
    block[rows, cols] = table.column(value).to_numpy()
    given[rows, cols] = True
    return block, given


def convolved_at(values: DataFrame, kernels: dict[str, np.ndarray], at: DataFrame, tile: int = TILE) -> DataFrame:
    """The rows of `at` (row, col, ...) with a column for each kernel: its layer's convolution there.

    `values` has (layer, row, col, value); values of one cell are added up.
    """
    reach = max((k.shape[0] // 2 for k in kernels.values()), default=0)
    size = side(reach, tile)
    summed = values.where(F.col("layer").isin(list(kernels))).groupBy("layer", "row", "col").agg(F.sum("value").alias("value")).where("value <> 0")
    dealt = with_halo(summed, size, reach)
    wanted = at.withColumns({"tile_row": _tile("row", size), "tile_col": _tile("col", size)})
    names = at.columns

    def meet(key, left, right):
        here = key[0].as_py(), key[1].as_py()
        out = right.select(names)
        rows, cols = right.column("row").to_numpy() - here[0] * size, right.column("col").to_numpy() - here[1] * size
        layer = left.column("layer")
        for name, kernel in kernels.items():
            mine = left.filter(pa.compute.equal(layer, name))
            got = np.zeros(len(right))
            if len(mine) and len(right):
                got = tile_sums(_block(mine, "value", size, reach, here)[0], kernel, size, reach)[rows, cols]
            out = out.append_column(name, pa.array(got))
        return out

    schema = at.schema
    for name in kernels:
        schema = schema.add(name, "double")
    return dealt.groupBy("tile_row", "tile_col").cogroup(wanted.groupBy("tile_row", "tile_col")).applyInArrow(meet, schema)


def convolved(values: DataFrame, kernel: np.ndarray, keys: list[str], value: str, name: str, tile: int = TILE) -> DataFrame:
    """(keys, row, col, name) for every cell within the kernel's square of a given cell."""
    reach = kernel.shape[0] // 2
    size = side(reach, tile)
    summed = values.groupBy(*keys, "row", "col").agg(F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias("__v"))
    dealt = with_halo(summed.withColumns({"row": F.col("row").cast("long"), "col": F.col("col").cast("long")}), size, reach)
    types = dealt.select(*keys).schema

    def run(key, table):
        here = key[-2].as_py(), key[-1].as_py()
        block, given = _block(table, "__v", size, reach, here)
        rows, cols = np.nonzero(reached(given, reach, size, reach))
        got = tile_sums(block, kernel, size, reach)[rows, cols]
        same = [pa.array([k.as_py()] * len(rows), k.type) for k in key[:-2]]
        return pa.table([*same, pa.array(rows + here[0] * size), pa.array(cols + here[1] * size), pa.array(got)], names=[*keys, "row", "col", name])

    return dealt.groupBy(*keys, "tile_row", "tile_col").applyInArrow(run, types.add("row", "long").add("col", "long").add(name, "double"))
