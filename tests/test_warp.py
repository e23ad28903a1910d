import math

import pytest
from pyspark.sql import functions as F

from cellweave.functions.grid import Grid, transformed
from cellweave.operators import spatial


def one(spark, x, y, source, target):
    return spark.range(1).select(*transformed(F.lit(x), F.lit(y), source, target)).first()


def test_control_points(spark):
    """Published positions: the equator and 45 degrees on a meridian, and a landmark."""
    assert tuple(one(spark, 111.0, 0.0, 4326, 32649)) == pytest.approx((500000.0, 0.0), abs=1e-6)
    assert tuple(one(spark, 111.0, 45.0, 4326, 32649)) == pytest.approx((500000.0, 4982950.40), abs=0.01)
    assert tuple(one(spark, 2.2945, 48.8582, 4326, 32631)) == pytest.approx((448251.8, 5411932.7), abs=1.0)
    assert tuple(one(spark, 111.0, -45.0, 4326, 32749)) == pytest.approx((500000.0, 1e7 - 4982950.40), abs=0.01)
    x, y = one(spark, 700000.0, 3800000.0, 32649, 32650)
    assert tuple(one(spark, x, y, 32650, 32649)) == pytest.approx((700000.0, 3800000.0), abs=1e-4)
    with pytest.raises(ValueError, match="not supported"):
        one(spark, 0.0, 0.0, 4326, 3857)


def test_a_plane_is_warped_exactly(spark):
    source = Grid(90, 80, 112.0, 35.0, 0.01, 4326)
    value = lambda lon, lat: 3.0 * lon - 2.0 * lat
    cells = spark.createDataFrame([(r, c, value(112.0 + (c + 0.5) * 0.01, 35.0 - (r + 0.5) * 0.01)) for r in range(80) for c in range(90)], "row long, col long, v double").repartition(3)
    target = Grid(60, 50, 610000.0, 3850000.0, 900.0)
    got = spatial.warp(cells, source, target, "v", tile_cells=16)
    assert got.count() == 3000
    lon, lat = transformed(target.x(F.col("col")), target.y(F.col("row")), 32649, 4326)
    rows = got.select("v", lon.alias("lon"), lat.alias("lat")).collect()
    inner = [r for r in rows if 112.006 < r.lon < 112.894 and 34.206 < r.lat < 34.994]
    assert len(inner) > 2000 and all(r.v == pytest.approx(value(r.lon, r.lat), abs=1e-8) for r in inner)
    assert all(r.v is None for r in rows if r.lon > 112.92 or r.lat > 35.02)


def test_nearest_and_missing(spark):
    source = Grid(3, 3, 500000.0, 1000.0, 100.0)
    cells = spark.createDataFrame([(r, c, None if (r, c) == (1, 1) else float(10 * r + c)) for r in range(3) for c in range(3)], "row int, col int, v double")
    same = {(r.row, r.col): r.v for r in spatial.warp(cells, source, Grid(6, 6, 500000.0, 1000.0, 50.0), "v", "nearest").collect()}
    assert all(same[r, c] == (None if (r // 2, c // 2) == (1, 1) else 10 * (r // 2) + c // 2) for r in range(6) for c in range(6))
    assert spatial.warp(cells, source, source, "v").where("v IS NULL").select("row", "col").collect() == [(1, 1)]
    other = {(r.row, r.col): r.v for r in spatial.warp(cells, source, Grid(4, 4, 500000.0, 1000.0, 80.0), "v").collect()}
    old = {(r.row, r.col): r.v for r in spatial.resample(cells, source, Grid(4, 4, 500000.0, 1000.0, 80.0), "v").collect()}
    assert all(math.isclose(other[k], old[k], abs_tol=1e-9) if old[k] is not None else other[k] is None for k in old)
    with pytest.raises(ValueError):
        spatial.warp(cells, source, source, "v", "cubic")
