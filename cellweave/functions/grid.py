"""Grid arithmetic: cells, blocks, and the transverse Mercator projection as column functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A north-up grid of square cells; the origin is its north-west corner."""

    width: int
    height: int
    origin_x: float
    origin_y: float
    size: float = 100.0
    epsg: int = 32649

    def __post_init__(self) -> None:
        if self.width < 1 or self.height < 1 or not self.size > 0 or not all(map(math.isfinite, (self.origin_x, self.origin_y, self.size))):
            raise ValueError("a grid needs positive dimensions and a finite origin")

    def aligned(self, other: Grid, tolerance: float = 1e-9) -> bool:
        same = (self.width, self.height, self.epsg) == (other.width, other.height, other.epsg)
        return same and all(abs(a - b) <= tolerance for a, b in ((self.origin_x, other.origin_x), (self.origin_y, other.origin_y), (self.size, other.size)))

    def column(self, x: Column) -> Column:
        return F.floor((x - self.origin_x) / self.size)

    def row(self, y: Column) -> Column:
        return F.floor((self.origin_y - y) / self.size)

    def cell(self, x: Column, y: Column) -> Column:
        """Row-major cell number of a point, NULL outside the grid."""
        row, column = self.row(y), self.column(x)
        return F.when(row.between(0, self.height - 1) & column.between(0, self.width - 1), row * self.width + column)

    def index(self, row: Column, column: Column) -> Column:
        """Cell number of a row and column; an error outside the grid."""
        inside = row.between(0, self.height - 1) & column.between(0, self.width - 1)
        return F.when(F.coalesce(inside, F.lit(False)), row * self.width + column).otherwise(F.raise_error(F.lit("cell outside the grid")))

    def x(self, column: Column) -> Column:
        return self.origin_x + (column + 0.5) * self.size

    def y(self, row: Column) -> Column:
        return self.origin_y - (row + 0.5) * self.size


def cell_name(row: Column, column: Column) -> Column:
    return F.format_string("utm49_r%d_c%d", row, column)


def block(x: Column, y: Column, size: float, origin: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Name of the square block that a point is in; right for negative coordinates."""
    return F.concat(F.lit("b"), F.floor((x - origin[0]) / size).cast("string"), F.lit("_"), F.floor((y - origin[1]) / size).cast("string"))


# WGS 84 ellipsoid and the universal transverse Mercator zone 49 N.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, CENTRAL_MERIDIAN, FALSE_EASTING = 0.9996, 111.0, 500000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krueger's series to the fourth order in the third flattening.
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def transverse_sql() -> dict[str, str]:
    """The two series as SQL over xi, eta and over x, e, chi, and the constants that go with them."""

    def series(factors: tuple, first: str, second: str) -> str:
        return " + ".join(f"({a!r}::DOUBLE) * " + first.format(j=2 * j) + second.format(j=2 * j) for j, a in enumerate(factors, 1))

    return {
        "easting": series(_FORWARD, "cos({j} * xi)", " * sinh({j} * eta)"), "northing": series(_FORWARD, "sin({j} * xi)", " * cosh({j} * eta)"),
        "x": series(_BACK, "sin({j} * xi)", " * cosh({j} * eta)"), "e": series(_BACK, "cos({j} * xi)", " * sinh({j} * eta)"), "latitude": series(_LATITUDE, "sin({j} * chi)", ""),
        "unit": f"({SCALE * _RADIUS!r}::DOUBLE)", "root": f"({2 * math.sqrt(_N) / (1 + _N)!r}::DOUBLE)", "meridian": f"({CENTRAL_MERIDIAN!r}::DOUBLE)", "shift": f"({FALSE_EASTING!r}::DOUBLE)",
    }


def to_utm(longitude: Column, latitude: Column, meridian: float = CENTRAL_MERIDIAN) -> tuple[Column, Column]:
    """Easting and northing (of the northern half) of a point in degrees, within millimetres inside the zone."""
    root = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(latitude), F.radians(longitude - meridian)
    t = F.sinh(F.atanh(F.sin(phi)) - root * F.atanh(root * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    easting = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    northing = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_FORWARD, 1))
    return FALSE_EASTING + SCALE * _RADIUS * easting, SCALE * _RADIUS * northing


def to_degrees(easting: Column, northing: Column, meridian: float = CENTRAL_MERIDIAN) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a point in the zone."""
    xi, eta = northing / (SCALE * _RADIUS), (easting - FALSE_EASTING) / (SCALE * _RADIUS)
    x = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BACK, 1))
    e = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BACK, 1))
    chi = F.asin(F.sin(x) / F.cosh(e))
    latitude = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_LATITUDE, 1))
    return meridian + F.degrees(F.atan2(F.sinh(e), F.cos(x))), F.degrees(latitude)


def zone(epsg: int) -> tuple[float, float]:
    """(central meridian, false northing) of a universal transverse Mercator zone on WGS 84."""
    if 32601 <= epsg <= 32660:
        return (epsg - 32600) * 6.0 - 183.0, 0.0
    if 32701 <= epsg <= 32760:
        return (epsg - 32700) * 6.0 - 183.0, 10_000_000.0
    raise ValueError(f"reference system {epsg} is not supported")


def transformed(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """A point of one reference system in another: WGS 84 degrees (4326, x is the longitude) and its Mercator zones."""
    if source == target:
        return x, y
    if source != 4326:
        meridian, false = zone(source)
        x, y = to_degrees(x, y - false, meridian)
    if target == 4326:
        return x, y
    meridian, false = zone(target)
    easting, northing = to_utm(x, y, meridian)
    return easting, northing + false
