import contextlib
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from cellweave.cli import main
from cellweave.functions.grid import Grid
from cellweave.sources import geotiff as gt
from cellweave.sources import rasters


def lzw(data):
    """A plain encoder, for the decoder's test."""
    out, bits, n = bytearray(), 0, 0

    def put(code, width):
        nonlocal bits, n
        bits, n = (bits << width) | code, n + width
        while n >= 8:
            out.append((bits >> (n - 8)) & 255)
            n -= 8
            bits &= (1 << n) - 1

    table = {bytes([i]): i for i in range(256)}
    size, width, word = 258, 9, b""
    put(256, 9)
    for b in data:
        if word + bytes([b]) in table:
            word += bytes([b])
            continue
        put(table[word], width)
        table[word + bytes([b])] = size
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
        if size >= 4094:
            put(256, width)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([b])
    if word:
        put(table[word], width)
        size += 1
        width = 12 if size >= 2048 else 11 if size >= 1024 else 10 if size >= 512 else 9
    put(257, width)
    if n:
        put(0, 8 - n)
    return bytes(out)


def build(values, compression=1, predictor=1, order="<", tile=None, big=False, no_data=None):
    """A TIFF file by the book, with every feature that the reader claims."""
    v = values.astype(values.dtype.newbyteorder(order))
    h, w = v.shape
    code = {1: lambda d: d, 8: zlib.compress, 5: lzw}[compression]

    def encode(block):
        if predictor == 2:
            block = np.diff(block, axis=1, prepend=block.dtype.type(0)).astype(block.dtype)
        if predictor == 3:
            raw = block.astype(block.dtype.newbyteorder(">")).view(np.uint8).reshape(block.shape[0], block.shape[1], -1).transpose(0, 2, 1).reshape(block.shape[0], -1)
            return code(np.diff(raw, axis=1, prepend=np.uint8(0)).astype(np.uint8).tobytes())
        return code(np.ascontiguousarray(block).tobytes())

    if tile:
        padded = np.zeros((-(-h // tile) * tile, -(-w // tile) * tile), v.dtype)
        padded[:h, :w] = v
        parts = [encode(padded[r : r + tile, c : c + tile]) for r in range(0, h, tile) for c in range(0, w, tile)]
    else:
        parts = [encode(v[r : r + 3]) for r in range(0, h, 3)]
    word, room = ("Q", 8) if big else ("I", 4)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0))
    offsets, body = [], bytearray(head)
    for p in parts:
        offsets.append(len(body))
        body += p
    long = 16 if big else 4
    tags = [(256, 3, [w]), (257, 3, [h]), (258, 3, [v.dtype.itemsize * 8]), (259, 3, [compression]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[v.dtype.kind]])]
    tags += [(322, 3, [tile]), (323, 3, [tile]), (324, long, offsets), (325, long, [len(p) for p in parts])] if tile else [(273, long, offsets), (278, 3, [3]), (279, long, [len(p) for p in parts])]
    tags += [(33550, 12, [100.0, 100.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 650000.0, 3870000.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32649])]
    if no_data is not None:
        tags.append((42113, 2, f"{no_data}\0".encode()))
    at = len(body)
    table, extra = [], b""
    far = at + (8 if big else 2) + len(tags) * (20 if big else 12) + room
    for tag, kind, values_ in sorted(tags):
        packed = values_ if kind == 2 else struct.pack(f"{order}{len(values_)}{gt.FIELDS[kind]}", *values_)
        place = packed.ljust(room, b"\0") if len(packed) <= room else struct.pack(order + word, far + len(extra))
        extra += b"" if len(packed) <= room else packed
        table.append(struct.pack(order + "HH" + word, tag, kind, len(values_)) + place)
    body += struct.pack(order + ("Q" if big else "H"), len(tags)) + b"".join(table) + struct.pack(order + word, 0) + extra
    body[(8 if big else 4) : (16 if big else 8)] = struct.pack(order + word, at)
    return bytes(body)


CASES = [{}, {"compression": 8}, {"compression": 5}, {"order": ">"}, {"tile": 16}, {"tile": 16, "compression": 5, "predictor": 2}, {"compression": 8, "predictor": 2, "order": ">"}, {"big": True}, {"big": True, "order": ">", "compression": 8}]


@pytest.mark.parametrize("how", CASES)
@pytest.mark.parametrize("kind", ["u1", "i2", "f4", "f8"])
def test_reader(how, kind):
    if how.get("predictor") == 2 and kind[0] == "f":
        how = how | {"predictor": 3}
    rng = np.random.default_rng(0)
    values = (rng.random((37, 53)) * 120).astype(kind)
    got = gt.parse(build(values, **how))
    assert (got.values == values).all() and got.grid == Grid(53, 37, 650000.0, 3870000.0)


def test_lzw_over_many_codes():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 9, 60_000).astype(np.uint8).tobytes()
    assert gt._lzw(lzw(data)) == data


def test_no_data_and_errors():
    values = np.array([[1.0, -9999.0], [np.nan, 0.0]], "f4")
    got = gt.parse(build(values, no_data=-9999))
    assert got.missing.tolist() == [[False, True], [True, False]]
    with pytest.raises(ValueError, match="TIFF"):
        gt.parse(b"nothing here")
    with pytest.raises(ValueError, match="compression"):
        gt._decoded(b"", 7)


@pytest.mark.parametrize("big", [False, True])
def test_write_and_read_back(spark, tmp_path, big):
    grid = Grid(37, 50, 350000.0, 3850000.0)
    rows = [(r, c, None if (r + c) % 5 == 0 else r + c / 10) for r in range(50) for c in range(37) if r not in range(16, 33)]
    cells = spark.createDataFrame(rows, "row long, col long, v double").repartition(3)
    path = str(tmp_path / "v.tif")
    rasters.write_raster(cells, grid, "v", path, tile=16, big=big, texts={"a": "x < y", "b": "z"})
    back = gt.parse(open(path, "rb").read())
    assert back.grid == grid and back.no_data == -9999.0 and rasters.raster_texts(path) == {"a": "x < y", "b": "z"}
    want = {(r, c): v for r, c, v in rows}
    got = {(r.row, r.col): r.value for r in rasters.read_rasters(spark, path).collect()}
    assert len(got) == 37 * 50
    assert all(got[k] == (None if want.get(k) is None else pytest.approx(want[k], abs=1e-5)) for k in got)
    with pytest.raises(FileExistsError):
        rasters.write_raster(cells, grid, "v", path)
    assert [p.name for p in tmp_path.iterdir()] == ["v.tif"]


def test_small_and_empty_rasters(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 3.0)], "row long, col long, v double")
    rasters.write_raster(cells, Grid(5, 4, 0.0, 0.0), "v", str(tmp_path / "one.tif"), "u1", 0)
    assert gt.parse((tmp_path / "one.tif").read_bytes()).values[0].tolist() == [3, 0, 0, 0, 0]
    rasters.write_raster(cells.where("v > 9"), Grid(5, 4, 0.0, 0.0), "v", str(tmp_path / "none.tif"))
    assert gt.parse((tmp_path / "none.tif").read_bytes()).missing.all()
    with pytest.raises(Exception, match="outside the grid"):
        rasters.write_raster(spark.createDataFrame([(9, 0, 3.0)], "row long, col long, v double"), Grid(5, 4, 0.0, 0.0), "v", str(tmp_path / "out.tif"))
    assert not (tmp_path / "out.tif").exists()


def read_bytes(monkeypatch, path, *filters):
    """(bytes that a reader with these filters reads, cells by place)."""
    seen = []
    plain = rasters.ranged

    @contextlib.contextmanager
    def counted(name):
        with plain(name) as read:
            yield lambda start, size: seen.append(size) or read(start, size)

    monkeypatch.setattr(rasters, "ranged", counted)
    reader = rasters.RasterReader(path)
    assert list(reader.pushFilters(list(filters))) == list(filters)
    cells = {}
    assert not filters or len(reader.partitions()) < len(rasters.RasterReader(path).partitions())
    for run in reader.partitions():
        for batch in reader.read(run):
            cells |= {(layer, r, c): v for layer, r, c, v in zip(*(batch.column(n).to_pylist() for n in ("layer", "row", "col", "value")))}
    monkeypatch.setattr(rasters, "ranged", plain)
    return sum(seen), cells


@pytest.mark.parametrize("how", [{"compression": 8}, {"tile": 16, "compression": 8}, {"tile": 16, "big": True, "order": ">"}])
def test_windows_read_their_byte_ranges_only(spark, tmp_path, monkeypatch, how):
    monkeypatch.setattr(rasters, "RUN_BYTES", 20_000)
    rng = np.random.default_rng(3)
    values = {name: rng.random((300, 260)).astype("f4") for name in "ab"}
    for name, v in values.items():
        (tmp_path / f"{name}.tif").write_bytes(build(v, **how))
    size = sum((tmp_path / f"{n}.tif").stat().st_size for n in "ab")
    every, cells = read_bytes(monkeypatch, str(tmp_path))
    assert every > 0.95 * size and len(cells) == 2 * 300 * 260 and all(cells[n, r, c] == values[n][r, c] for n, r, c in list(cells)[::37])
    few, part = read_bytes(monkeypatch, str(tmp_path), EqualTo(("layer",), "b"), GreaterThanOrEqual(("row",), 150), LessThan(("row",), 153), GreaterThan(("col",), 40), LessThanOrEqual(("col",), 60))
    assert few < 0.05 * size and {("b", r, c) for r in range(150, 153) for c in range(41, 61)} <= set(part) and part.items() <= cells.items()
    assert read_bytes(monkeypatch, str(tmp_path), EqualTo(("row",), 900))[1] == {}
    frame = rasters.read_rasters(spark, str(tmp_path))
    window = frame.where("layer = 'b' AND row >= 150 AND row < 153 AND col > 40 AND col <= 60")
    assert {(r.row, r.col): r.value for r in window.collect()} == {(r, c): values["b"][r, c] for r in range(150, 153) for c in range(41, 61)}
    assert frame.where("row = 900").count() == 0


def test_raster_command_on_tiff(spark, tmp_path):
    rng = np.random.default_rng(2)
    layers = {"m": rng.random((6, 8)), "habitat_suitability": np.full((6, 8), 0.9), "h": rng.random((6, 8)) * 0.9, "feasible": np.ones((6, 8))}
    args = []
    for name, values in layers.items():
        values[0] = -9999
        (tmp_path / f"{name}.tif").write_bytes(build(values.astype("f4"), compression=8, no_data=-9999))
        args += [f"--{name.replace('_', '-')}", str(tmp_path / f"{name}.tif")]
    got = main(["raster", *args, "--out", str(tmp_path / "out")], spark)
    assert got["valid_cells"] == 40 and got["zones"]["0"] == 8
    zones = gt.parse((tmp_path / "out" / "zone.tif").read_bytes())
    cells = {(r.row, r.col): r.zone for r in spark.read.parquet(str(tmp_path / "out" / "cells")).collect()}
    assert all(zones.values[k] == z for k, z in cells.items()) and zones.values.dtype == np.uint8
    assert rasters.raster_texts(str(tmp_path / "out" / "zone.tif"))["zone_2"] == "restoration_candidate_reference"
