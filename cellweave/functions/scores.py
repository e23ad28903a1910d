"""Column functions of the scoring core; missing values are NULL and never zero."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor under a logarithm's argument, and the tolerance of h over its reference.
EPSILON = 1e-8
TOLERANCE = 1e-6
SEASONS = ("spring", "summer", "autumn", "winter")


def checked_unit(value: Column, name: str, allow_null: bool = True) -> Column:
    """The value, or an error where it is infinite, NaN or outside [0, 1] (or NULL, unless allowed)."""
    bad = ~value.between(0.0, 1.0) | F.isnan(value)
    bad = F.coalesce(bad, F.lit(False)) if allow_null else F.coalesce(bad, F.lit(True))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"{name} outside [0, 1]: "), F.coalesce(value.cast("string"), F.lit("NULL"))))).otherwise(value)


def geometric(a: Column, b: Column, weight: Column | float = 0.5) -> Column:
    """Weighted geometric mean of two values in [0, 1]; a weight of 0 or 1 picks one input, a zero with weight gives zero."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    low = F.lit(EPSILON)
    mean = F.exp(w * F.ln(F.greatest(a, low)) + (1.0 - w) * F.ln(F.greatest(b, low)))
    zero = ((a == 0.0) & (w > 0.0)) | ((b == 0.0) & (w < 1.0))
    return F.when(a.isNull() | b.isNull(), None).when(w == 1.0, a).when(w == 0.0, b).when(zero, 0.0).otherwise(mean)


def linear(a: Column, b: Column, weight: Column | float = 0.5) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * a + (1.0 - w) * b


def minimum(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def combine(a: Column, b: Column, method: str, weight: Column | float) -> Column:
    """One of the fusion methods: geometric, linear or minimum."""
    if method == "minimum":
        return minimum(a, b)
    return {"geometric": geometric, "linear": linear}[method](a, b, weight)


def relative_degradation(h: Column, reference: Column) -> Column:
    """Lost share of the reference quality; NULL where either is missing or the reference is zero."""
    kept = F.least(F.greatest(F.try_divide(h, reference), F.lit(0.0)), F.lit(1.0))
    return F.when(h.isNotNull() & (reference > 0), 1.0 - kept)


def fuse(m: Column, h: Column, feasible: Column, reference: Column, alpha: float = 0.5, gamma: float = 0.5, method: str = "geometric", deficit: str = "low_hq") -> dict[str, Column]:
    """conservation, restoration and eligible columns; NULL where an input is missing."""
    if deficit not in ("low_hq", "relative_degradation"):
        raise ValueError(f"unknown deficit mode {deficit!r}")
    missing = m.isNull() | h.isNull() | feasible.isNull() | reference.isNull()
    gap = 1.0 - h if deficit == "low_hq" else F.when(reference == 0, 0.0).otherwise(relative_degradation(h, reference))
    eligible = (feasible == 1) & (reference > 0)
    return {
        "conservation": F.when(~missing, combine(m, h, method, alpha)),
        "restoration": F.when(missing, None).when(~eligible, 0.0).otherwise(combine(m, gap, method, gamma)),
        "eligible": F.when(missing, None).otherwise(eligible),
    }


def zone(m: Column, h: Column, feasible: Column, reference: Column, m_high: float = 0.7, h_high: float = 0.7) -> Column:
    """Management zone: 1 keep, 2 restore, 3 good habitat of low use, 4 low, 5 not restorable, 0 unknown."""
    missing = m.isNull() | h.isNull() | feasible.isNull() | reference.isNull()
    high_m, high_h = m >= m_high, h >= h_high
    return (
        F.when(missing, 0)
        .when(high_m & high_h, 1)
        .when(~high_m & high_h, 3)
        .when(high_m & (feasible == 1) & (reference > 0), 2)
        .when(high_m, 5)
        .otherwise(4)
        .cast("tinyint")
    )


def season_index(season: Column) -> Column:
    return F.array_position(F.array(*(F.lit(s) for s in SEASONS)), season).cast("int") - 1


def features(m: Column, h: Column, u_m: Column, u_h: Column, season: Column) -> dict[str, Column]:
    """The gate's inputs as 32-bit floats."""
    angle = 2.0 * math.pi * season_index(season) / 4.0
    return {k: v.cast("float") for k, v in {"m": m, "h": h, "u_m": u_m, "u_h": u_h, "season_sin": F.sin(angle), "season_cos": F.cos(angle)}.items()}


def envelope_residual(target: Column, a: Column, b: Column, least_weight: float) -> Column:
    """How far a target lies outside what the geometric mean can reach with weights in [w, 1 - w]."""
    one, two = geometric(a, b, least_weight), geometric(a, b, 1.0 - least_weight)
    low, high = F.least(one, two), F.greatest(one, two)
    known = target.isNotNull() & one.isNotNull() & two.isNotNull()
    return F.when(known, F.greatest(low - target, target - high, F.lit(0.0)))


def controls(m: Column, factor: Column, fitted_geometric: float, fitted_linear: float) -> dict[str, Column]:
    """Fixed and fitted controls of one target, whose second factor is `factor`."""
    return {
        "m_only": F.when(factor.isNotNull(), m),
        "factor_only": F.when(m.isNotNull(), factor),
        "geometric_half": geometric(m, factor, 0.5),
        "linear_half": linear(m, factor, 0.5),
        "geometric_fitted": geometric(m, factor, fitted_geometric),
        "linear_fitted": linear(m, factor, fitted_linear),
        "minimum": minimum(m, factor),
    }


def detection(p: Column, visits: Column) -> Column:
    """Probability of at least one detection in that many visits."""
    return 1.0 - F.pow(1.0 - p, visits)


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1.0 + F.exp(-F.abs(x))))
