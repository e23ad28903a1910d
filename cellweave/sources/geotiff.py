"""The format of one-band GeoTIFF files, after the public TIFF 6.0 and GeoTIFF 1.1 specifications.

Read: classic and big TIFF, both byte orders, strips or tiles, no compression,
Deflate or LZW, horizontal and floating-point predictors, integers and floats.
Written: Deflate tiles, big TIFF where offsets need it.  `rasters` has the data
source and sink that use it block by block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import numpy as np

from cellweave.functions.grid import Grid

# Fixed values of the specifications: tag numbers, and struct codes of field types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, METADATA, NO_DATA = 33550, 33922, 34264, 34735, 42112, 42113
MODEL_TYPE_KEY, RASTER_TYPE_KEY, PROJECTED_KEY, GEOGRAPHIC_KEY = 1024, 1025, 3072, 2048
FIELDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q"}


@dataclass(frozen=True)
class Raster:
    """Values with NaN (or the no-data value, for integers, in `missing`) and the grid they are on."""

    values: np.ndarray
    missing: np.ndarray
    no_data: float | None
    grid: Grid


def _lzw(data: bytes) -> bytes:
    out, table = bytearray(), []
    width, previous, bits, held = 9, b"", 0, 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("broken LZW data")
        out += entry
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        # The width grows one code early.
        width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


class Directory:
    """The first directory of a file; long arrays (the blocks' places) are read in parts, when asked for.

    `read(start, size)` gives bytes of the file, so a directory costs a few small reads of a file of any size.
    """

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if self.order is None or len(head) < 8:
            raise ValueError("not a TIFF file")
        version = struct.unpack_from(self.order + "H", head, 2)[0]
        if version not in (42, 43):
            raise ValueError("not a TIFF file")
        self.big = version == 43
        word, room = ("Q", 8) if self.big else ("I", 4)
        at = struct.unpack_from(self.order + word, head, 8 if self.big else 4)[0]
        start, step = (8, 20) if self.big else (2, 12)
        count = struct.unpack(self.order + ("Q" if self.big else "H"), read(at, start))[0]
        table = read(at + start, count * step)
        #: tag -> (field type, number of values, where they begin)
        self.entries: dict[int, tuple[int, int, int]] = {}
        for k in range(count):
            tag, kind = struct.unpack_from(self.order + "HH", table, k * step)
            number = struct.unpack_from(self.order + word, table, k * step + 4)[0]
            if kind not in FIELDS:
                continue
            where = at + start + k * step + 4 + room
            if number * struct.calcsize("<" + FIELDS[kind]) > room:
                where = struct.unpack_from(self.order + word, table, k * step + 4 + room)[0]
            self.entries[tag] = kind, number, where

    def __contains__(self, tag: int) -> bool:
        return tag in self.entries

    def part(self, tag: int, first: int, last: int) -> tuple:
        """Values first .. last - 1 of a tag."""
        kind, _, where = self.entries[tag]
        size = struct.calcsize("<" + FIELDS[kind])
        data = self.read(where + first * size, (last - first) * size)
        return (data,) if kind == 2 else struct.unpack(self.order + FIELDS[kind] * (last - first), data)

    def get(self, tag: int, default: tuple = ()) -> tuple:
        return self.part(tag, 0, self.entries[tag][1]) if tag in self.entries else default


def _decoded(data: bytes, compression: int) -> bytes:
    if compression == 1:
        return data
    if compression in (8, 32946):
        return zlib.decompress(data)
    if compression == 5:
        return _lzw(data)
    raise ValueError(f"compression {compression} is not supported")


def _block(data: bytes, rows: int, columns: int, dtype: np.dtype, predictor: int) -> np.ndarray:
    if predictor == 3:
        raw = np.frombuffer(data, np.uint8, rows * columns * dtype.itemsize).reshape(rows, -1)
        raw = np.cumsum(raw, axis=1, dtype=np.uint8)
        # Bytes are stored plane by plane, the most significant first.
        planes = raw.reshape(rows, dtype.itemsize, columns).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view(dtype.newbyteorder(">")).reshape(rows, columns).astype(dtype.newbyteorder("="))
    values = np.frombuffer(data, dtype, rows * columns).reshape(rows, columns).astype(dtype.newbyteorder("="))
    return np.cumsum(values, axis=1, dtype=values.dtype) if predictor == 2 else values


@dataclass(frozen=True)
class Layout:
    """How a one-band, north-up raster is cut into blocks (strips or tiles), and where it lies."""

    grid: Grid
    dtype: np.dtype
    no_data: float | None
    compression: int
    predictor: int
    tall: int
    wide: int
    offsets: int
    counts: int

    @property
    def across(self) -> int:
        return -(-self.grid.width // self.wide)

    @property
    def down(self) -> int:
        return -(-self.grid.height // self.tall)

    def values(self, data: bytes, k: int) -> tuple[int, int, np.ndarray, np.ndarray]:
        """(first row, first column, values, missing) of block k from its bytes."""
        row, col = k // self.across * self.tall, k % self.across * self.wide
        # A strip ends with the raster, a tile is whole.
        tall = min(self.tall, self.grid.height - row) if self.offsets == OFFSETS else self.tall
        part = _block(_decoded(data, self.compression), tall, self.wide, self.dtype, self.predictor)[: self.grid.height - row, : self.grid.width - col]
        return row, col, part, self.missing(part)

    def missing(self, part: np.ndarray) -> np.ndarray:
        missing = np.isnan(part) if part.dtype.kind == "f" else np.zeros(part.shape, bool)
        if self.no_data is not None and self.no_data == self.no_data:
            missing |= part == np.array(self.no_data).astype(part.dtype)
        return missing


def layout(tags: Directory) -> Layout:
    """The layout of a one-band, north-up raster; an error for anything else."""
    if tags.get(SAMPLES, (1,))[0] != 1:
        raise ValueError("one band is expected")
    width, height = tags.get(WIDTH)[0], tags.get(HEIGHT)[0]
    kind = {1: "u", 2: "i", 3: "f"}[tags.get(FORMAT, (1,))[0]]
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        sx, sy = tags.get(PIXEL_SCALE)[:2]
        i, j, _, x, y = tags.get(TIE_POINT)[:5]
        left, top = x - i * sx, y + j * sy
    elif TRANSFORM in tags:
        a, b, _, left, d, e, _, top = tags.get(TRANSFORM)[:8]
        if b or d:
            raise ValueError("the raster is rotated")
        sx, sy = a, -e
    else:
        raise ValueError("the raster has no place on the ground")
    if sx <= 0 or abs(sx - sy) > 1e-9:
        raise ValueError("north-up square pixels are expected")
    keys = tags.get(GEO_KEYS)
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    text = b"".join(tags.get(NO_DATA, (b"",))).rstrip(b"\x00 ").decode("ascii", "replace")
    tiled = TILE_OFFSETS in tags
    tall, wide = (tags.get(TILE_HEIGHT)[0], tags.get(TILE_WIDTH)[0]) if tiled else (min(height, tags.get(ROWS, (height,))[0]), width)
    return Layout(
        Grid(width, height, float(left), float(top), float(sx), int(codes.get(PROJECTED_KEY, codes.get(GEOGRAPHIC_KEY, 0)))),
        np.dtype(f"{tags.order}{kind}{tags.get(BITS)[0] // 8}"), float(text) if text else None, tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], tall, wide,
        TILE_OFFSETS if tiled else OFFSETS, TILE_COUNTS if tiled else COUNTS,
    )


def metadata(tags: Directory) -> dict[str, str]:
    """Named texts of a file (GDAL's metadata field)."""
    text = b"".join(tags.get(METADATA, (b"",))).rstrip(b"\x00").decode("utf-8")
    return {e.get("name", ""): e.text or "" for e in ElementTree.fromstring(text).iter("Item")} if text else {}


def parse(body: bytes) -> Raster:
    """A whole raster in memory, for small files."""
    tags = Directory(lambda start, size: body[start : start + size])
    plan = layout(tags)
    out = np.zeros((plan.grid.height, plan.grid.width), plan.dtype.newbyteorder("="))
    missing = np.ones(out.shape, bool)
    for k, (offset, count) in enumerate(zip(tags.get(plan.offsets), tags.get(plan.counts))):
        if count:
            row, col, part, gone = plan.values(body[offset : offset + count], k)
            here = np.s_[row : row + part.shape[0], col : col + part.shape[1]]
            out[here], missing[here] = part, gone
    return Raster(out, missing, plan.no_data, plan.grid)


def directory_bytes(grid: Grid, dtype: np.dtype, no_data: float, tile: int, blocks: int, places: tuple[int, int], at: int, big: bool, texts: dict[str, str]) -> bytes:
    """A directory to stand at byte `at`, for Deflate tiles whose offsets and byte counts stand at `places`."""
    word, room, long = ("Q", 8, 16) if big else ("I", 4, 4)
    xml = "<GDALMetadata>" + "".join(f"<Item name={quoteattr(k)}>{escape(v)}</Item>" for k, v in texts.items()) + "</GDALMetadata>\0"
    entries: list[tuple] = [
        (WIDTH, 4, [grid.width]), (HEIGHT, 4, [grid.height]), (BITS, 3, [dtype.itemsize * 8]), (COMPRESSION, 3, [8]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]),
        (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILE_OFFSETS, long, places[0]), (TILE_COUNTS, long, places[1]),
        (FORMAT, 3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]]), (PIXEL_SCALE, 12, [grid.size, grid.size, 0.0]), (TIE_POINT, 12, [0.0, 0.0, 0.0, grid.origin_x, grid.origin_y, 0.0]),
        (GEO_KEYS, 3, [1, 1, 0, 3, MODEL_TYPE_KEY, 0, 1, 1, RASTER_TYPE_KEY, 0, 1, 1, PROJECTED_KEY, 0, 1, grid.epsg]), *([(METADATA, 2, xml.encode())] if texts else []), (NO_DATA, 2, f"{no_data:g}\0".encode()),
    ]
    far = at + (8 if big else 2) + len(entries) * (20 if big else 12) + room
    table, extra = [struct.pack("<Q" if big else "<H", len(entries))], b""
    for tag, kind, values in entries:
        if isinstance(values, int):  # an array that stands elsewhere already
            table.append(struct.pack("<HH" + word + word, tag, kind, blocks, values))
            continue
        packed = values if kind == 2 else struct.pack(f"<{len(values)}{FIELDS[kind]}", *values)
        if len(packed) > room:
            table.append(struct.pack("<HH" + word + word, tag, kind, len(values), far + len(extra)))
            extra += packed + b"\0" * (-len(packed) % 8)
        else:
            table.append(struct.pack("<HH" + word, tag, kind, len(values)) + packed.ljust(room, b"\0"))
    return b"".join(table) + struct.pack("<" + word, 0) + extra
