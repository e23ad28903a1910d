"""Habitat quality by the published threat formula: decayed threats, sensitivity by class, half saturation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import convolve

#: The exponent of the half-saturation term (fixed in the published formula).
POWER = 2.5
#: An exponential threat has lost all but a hundredth at its largest distance.
EXPONENTIAL = 2.99


def decay_offsets(max_dist: float, decay: str, cell: float) -> list[tuple[int, int, float]]:
    """(row offset, column offset, share) of a threat's reach; nothing beyond its largest distance."""
    reach = int(max_dist // cell)
    out = []
    for dr in range(-reach, reach + 1):
        for dc in range(-reach, reach + 1):
            d = math.hypot(dr, dc) * cell
            if d <= max_dist:
                share = 1 - d / max_dist if decay == "linear" else math.exp(-EXPONENTIAL * d / max_dist)
                if share > 0:
                    out.append((dr, dc, share))
    return out


def decay_kernel(max_dist: float, decay: str, cell: float) -> np.ndarray:
    """The offsets' shares as a square, adding up to one."""
    offsets = decay_offsets(max_dist, decay, cell)
    reach = int(max_dist // cell)
    out = np.zeros((2 * reach + 1,) * 2)
    for r, c, s in offsets:
        out[r + reach, c + reach] = s
    return out / out.sum()


def degradation(cells: DataFrame, threats: list[tuple[str, float, float, str]], sensitivity: DataFrame, cell: float = 100.0) -> DataFrame:
    """(row, col, lucode, degradation): decayed threats, weighted, times the class's sensitivity.

    `threats` are (layer, largest distance, weight, decay).  Tiles with halos are
    convolved, so about one row for each cell and threat is shuffled, whatever
    the distance.
    """
    total = sum(w for _, _, w, _ in threats)
    kernels = {name: decay_kernel(far, decay, cell) * (weight / total) for name, far, weight, decay in threats}
    layers = F.explode(F.array(*(F.struct(F.lit(n).alias("layer"), F.col(n).cast("double").alias("value")) for n in kernels)))
    values = cells.select("row", "col", layers.alias("__at")).select("__at.layer", "row", "col", "__at.value").where("value > 0")
    at = cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), "lucode").distinct()
    loads = convolve.convolved_at(values, kernels, at)
    known = sensitivity.select(F.col("lucode").alias("__code"), *(F.col(n).alias(f"__s_{n}") for n in kernels))
    joined = loads.join(known, F.col("lucode") == F.col("__code"), "left")
    suffered = sum((F.coalesce(F.col(n) * F.col(f"__s_{n}"), F.lit(0.0)) for n in kernels), F.lit(0.0))
    return joined.select("row", "col", "lucode", suffered.alias("degradation"))


def habitat_quality(cells: DataFrame, threats: list[tuple[str, float, float, str]], sensitivity: DataFrame, half: float, cell: float = 100.0) -> DataFrame:
    """(row, col, degradation, quality); quality is NULL for a class without a suitability."""
    found = degradation(cells, threats, sensitivity, cell).join(sensitivity.select("lucode", "habitat"), "lucode", "left")
    d = F.pow("degradation", POWER)
    return found.select("row", "col", "degradation", (F.col("habitat") * (1.0 - d / (d + half**POWER))).alias("quality"))
