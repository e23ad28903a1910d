"""Maximum entropy of presences against background with an L1 penalty, for many groups at once.

The density over background cells is q(x) = exp(f(x) . c) / Z.  The fit minimises

    log Z - mean of f . c over presences + sum of penalty_j * |c_j|

by proximal Newton steps.  Each step needs log Z and the first and second moments
of the features under q: partitions sum them in one pass, Spark adds the sums by
group and component, and the driver holds a few thousand numbers for each group,
for any number of rows.  All groups step together, those that have converged drop
out.  Features are linear, quadratic and hinges of predictors scaled by the
group's own range; each one's penalty falls with the presences' count and grows
with its spread over them.

Defined results: rows with a missing predictor take no part; a group without
presences or background has null coefficients; the presences belong to the
background as well.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from cellweave.operators.ranking import match_left
from cellweave.sinks import checkpointed

HINGES = 4
ROUNDS = 200


def features(z: np.ndarray, classes: str, hinges: int = HINGES) -> np.ndarray:
    """Linear, quadratic and hinge features of predictors in [0, 1]; all lie in [0, 1]."""
    parts = [z]
    if "Q" in classes:
        parts.append(z**2)
    if "H" in classes:
        for k in range(1, hinges + 1):
            knot = k / (hinges + 1)
            parts += [np.clip((z - knot) / (1 - knot), 0, 1), np.clip((knot - z) / knot, 0, 1)]
    return np.concatenate(parts, axis=1)


def feature_names(names: list[str], classes: str, hinges: int = HINGES) -> list[str]:
    out = list(names)
    if "Q" in classes:
        out += [f"{n}^2" for n in names]
    if "H" in classes:
        for k in range(1, hinges + 1):
            out += [f"{n}>{k}/{hinges + 1}" for n in names] + [f"{n}<{k}/{hinges + 1}" for n in names]
    return out


@dataclass
class Fit:
    """One group's fit: feature coefficients, log Z, entropy of q, and the range that predictors are scaled by."""

    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    penalty: np.ndarray
    coefficients: np.ndarray
    log_z: float = 0.0
    entropy: float = 0.0
    objective: float = math.inf
    gap: float = math.inf
    converged: bool = False


def soft_newton(gradient: np.ndarray, hessian: np.ndarray, c: np.ndarray, penalty: np.ndarray, rounds: int = 500) -> np.ndarray:
    """The minimum of the quadratic model plus the penalty, by coordinate descent."""
    d = np.zeros_like(c)
    hd = np.zeros_like(c)
    curve = np.maximum(np.diag(hessian), 1e-10)
    for _ in range(rounds):
        moved = 0.0
        for j in range(len(c)):
            slope = gradient[j] + hd[j] + 1e-10 * d[j]
            at = c[j] + d[j]
            wanted = at - slope / curve[j]
            new = math.copysign(max(abs(wanted) - penalty[j] / curve[j], 0.0), wanted)
            step = new - at
            if step:
                d[j] += step
                hd += step * hessian[:, j]
                moved = max(moved, abs(step))
        if moved < 1e-10:
            break
    return d


def optimality_gap(gradient: np.ndarray, c: np.ndarray, penalty: np.ndarray) -> float:
    """How far the point is from the conditions of an optimum: |gradient| <= penalty at zero, gradient = -penalty * sign elsewhere."""
    at_zero = np.maximum(np.abs(gradient) - penalty, 0.0)
    return float(np.where(c == 0, at_zero, np.abs(gradient + penalty * np.sign(c))).max(initial=0.0))


def _sums(rows: DataFrame, fits: dict[int, Fit], names: list[str], classes: str) -> dict[int, tuple[float, float, np.ndarray, np.ndarray]]:
    """For each group number (log Z, mean of f . c, mean of f, second moments of f) under q; two small aggregations."""
    held = rows.sparkSession.sparkContext.broadcast({g: (f.low, f.high, f.coefficients) for g, f in fits.items()})
    # Coefficients bound the exponent, so one shift for each group keeps every exponential finite.
    shift = {g: float(np.maximum(f.coefficients, 0).sum()) for g, f in fits.items()}

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            group = batch.column("__g").to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]) if batch.num_rows else np.empty((0, len(names)))
            weight = batch.column("__b").to_numpy(zero_copy_only=False).astype(float)
            for g in np.unique(group):
                if int(g) not in held.value:
                    continue
                low, high, c = held.value[int(g)]
                here = group == g
                f = features(np.clip((x[here] - low) / np.where(high > low, high - low, 1.0), 0, 1), classes)
                eta = f @ c
                w = weight[here] * np.exp(eta - shift[int(g)])
                upper = ((f * w[:, None]).T @ f)[np.triu_indices(f.shape[1])]
                part = np.r_[w.sum(), (w * eta).sum(), w @ f, upper]
                total[int(g)] = total.get(int(g), 0.0) + part
        for g, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), g)), pa.array(np.arange(len(v))), pa.array(v)], names=["g", "k", "v"])

    summed = rows.mapInArrow(run, "g long, k long, v double").groupBy("g", "k").agg(F.sum("v").alias("v")).toArrow()
    out = {}
    for g, fit in fits.items():
        here = summed.filter(pa.compute.equal(summed.column("g"), g)).sort_by("k").column("v").to_numpy()
        n = len(fit.coefficients)
        mean = here[2 : 2 + n] / here[0]
        second = np.zeros((n, n))
        second[np.triu_indices(n)] = here[2 + n :] / here[0]
        out[g] = math.log(here[0]) + shift[g], here[1] / here[0], mean, second + np.triu(second, 1).T
    return out


def fit(rows: DataFrame, groups: list[str], names: list[str], positive: str, classes: str = "LQ", multiplier: float = 1.0, tolerance: float = 1e-6) -> tuple[DataFrame, dict[tuple, Fit]]:
    """((groups, term, coefficient, n_presence, entropy), fits by group).

    `positive` marks presences; every row is background.  The groups are a plan
    (seasons, folds), and their keys and fits are held by the driver.
    """
    spark = rows.sparkSession
    whole = rows.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names)).select(*groups, *(F.col(n).cast("double").alias(n) for n in names), F.col(positive).cast("boolean").alias("__p"))
    spans = whole.groupBy(*groups).agg(F.count(F.lit(1)).alias("b"), F.count_if("__p").alias("p"), *(f(n).alias(f"{s}{i}") for i, n in enumerate(names) for s, f in (("l", F.min), ("h", F.max)))).collect()
    spans.sort(key=lambda r: str(tuple(r)[: len(groups)]))
    numbers = spark.createDataFrame([(*tuple(r)[: len(groups)], k) for k, r in enumerate(spans)], whole.select(*groups).schema.add("__g", "long"))
    keyed = match_left(whole, numbers, groups).select("__g", *names, F.lit(1.0).alias("__b"), "__p")
    keyed = checkpointed(keyed)
    terms = feature_names(names, classes)
    fits: dict[int, Fit] = {}
    for k, r in enumerate(spans):
        low, high = (np.array([r[f"{s}{i}"] for i in range(len(names))], float) for s in "lh")
        fits[k] = Fit(low, high, np.zeros(len(terms)), np.zeros(len(terms)), np.zeros(len(terms)))
    able = {k: fits[k] for k, r in enumerate(spans) if 0 < r["p"] and 0 < r["b"]}
    if able:
        for g, (_, _, mean, second) in _sums(keyed.where("__p"), able, names, classes).items():
            f, p = able[g], spans[g]["p"]
            f.mean = mean
            # Wider for few presences and for features that vary over them, never zero.
            f.penalty = multiplier * np.maximum(np.sqrt(np.maximum(np.diag(second) - mean**2, 0.0)), 1e-3) / math.sqrt(p)
    live = dict(able)
    steps: dict[int, tuple[np.ndarray, np.ndarray, float, float]] = {}
    for _ in range(ROUNDS):
        if not live:
            break
        for g, (log_z, expected, mean, second) in _sums(keyed, live, names, classes).items():
            f = live[g]
            objective = log_z - float(f.mean @ f.coefficients) + float(f.penalty @ np.abs(f.coefficients))
            if g in steps and objective > steps[g][2] + 1e-4 * steps[g][3] + 1e-12 and np.abs(steps[g][1]).max() > 1e-12:
                before, step, value, slope = steps[g]
                steps[g] = before, step / 2, value, slope / 2
                f.coefficients = before + step / 2
                continue
            gradient = mean - f.mean
            f.log_z, f.entropy, f.objective = log_z, log_z - expected, objective
            f.gap = optimality_gap(gradient, f.coefficients, f.penalty)
            if f.gap <= tolerance:
                f.converged = True
                continue
            step = soft_newton(gradient, second - np.outer(mean, mean), f.coefficients, f.penalty)
            slope = float(gradient @ step + f.penalty @ (np.abs(f.coefficients + step) - np.abs(f.coefficients)))
            steps[g] = f.coefficients, step, objective, slope
            f.coefficients = f.coefficients + step
        live = {g: f for g, f in live.items() if not f.converged}
    if live:
        raise ValueError(f"{len(live)} fits did not converge")
    out = []
    for k, r in enumerate(spans):
        f, known = fits[k], k in able
        out += [(*tuple(r)[: len(groups)], t, float(c) if known else None, r["p"], float(f.entropy) if known else None) for t, c in zip(terms, f.coefficients)]
    schema = whole.select(*groups).schema.add("term", "string").add("coefficient", "double").add("n_presence", "long").add("entropy", "double")
    return spark.createDataFrame(out, schema), {tuple(r)[: len(groups)]: fits[k] for k, r in enumerate(spans)}


def project(rows: DataFrame, fits: dict[tuple, Fit], groups: list[str], names: list[str], classes: str = "LQ", name: str = "score") -> DataFrame:
    """Rows with the cloglog score 1 - exp(-q * exp(entropy)) of their group's fit; null without one or with a missing predictor.

    Predictors beyond the range of the fit are held at its ends.
    """
    spark = rows.sparkSession
    terms = feature_names(names, classes)
    known = [(*k, f.low.tolist(), f.high.tolist(), f.coefficients.tolist(), float(f.entropy - f.log_z)) for k, f in fits.items() if f.converged]
    schema = rows.select(*groups).schema
    for column in ("__low", "__high", "__c"):
        schema = schema.add(column, ArrayType(DoubleType()))
    schema = schema.add("__e", DoubleType())
    joined = match_left(rows, spark.createDataFrame(known, schema), groups)
    scaled = []
    for i, n in enumerate(names):
        width = F.col("__high")[i] - F.col("__low")[i]
        scaled.append(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(n) - F.col("__low")[i]) / F.when(width > 0, width).otherwise(1.0))))
    scaled = [F.when(F.col(n).isNotNull(), z) for n, z in zip(names, scaled)]
    parts = list(scaled)
    if "Q" in classes:
        parts += [z * z for z in scaled]
    if "H" in classes:
        for k in range(1, HINGES + 1):
            knot = k / (HINGES + 1)
            parts += [F.when(z.isNotNull(), F.greatest(F.lit(0.0), (z - knot) / (1 - knot))) for z in scaled] + [F.when(z.isNotNull(), F.greatest(F.lit(0.0), (knot - z) / knot)) for z in scaled]
    eta = sum((F.col("__c")[i] * p for i, p in enumerate(parts)), F.lit(0.0))
    assert len(parts) == len(terms)
    return joined.withColumn(name, 1.0 - F.exp(-F.exp(eta + F.col("__e")))).select(*rows.columns, name)
