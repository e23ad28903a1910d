import math

import numpy as np
import pytest

from cellweave.operators import maxent

NAMES = ["a", "b", "c"]


def rows(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for g in ("x", None):
        z = rng.random((n, 3))
        p = rng.random(n) < np.clip(0.5 * np.exp(-12 * (z[:, 0] - (0.3 if g else 0.7)) ** 2), 0, 1)
        out += [(g, *map(float, v), bool(q)) for v, q in zip(z, p)]
    return out + [("none", 0.1, 0.2, 0.3, False)] * 4 + [("x", None, 0.5, 0.5, True)]


def frame(spark, data):
    return spark.createDataFrame(data, "g string, a double, b double, c double, p boolean").repartition(5)


def test_optimality_entropy_and_sparsity(spark):
    data = rows()
    kept = {}
    for multiplier in (1.0, 8.0):
        found, fits = maxent.fit(frame(spark, data), ["g"], NAMES, "p", "LQH", multiplier)
        table = {(r.g, r.term): r.coefficient for r in found.collect()}
        assert table["none", "a"] is None
        for g in ("x", None):
            fit = fits[g,]
            here = np.array([r[1:] for r in data if r[0] == g and r[1] is not None], float)
            f = maxent.features((here[:, :3] - fit.low) / (fit.high - fit.low), "LQH")
            eta = f @ fit.coefficients
            q = np.exp(eta - eta.max())
            q /= q.sum()
            gradient = q @ f - f[here[:, 3] == 1].mean(axis=0)
            assert maxent.optimality_gap(gradient, fit.coefficients, fit.penalty) <= 2e-6
            assert fit.entropy == pytest.approx(-(q * np.log(q)).sum(), abs=1e-9)
            assert fit.log_z == pytest.approx(math.log(np.exp(eta).sum()), abs=1e-9)
        kept[multiplier] = sum(np.count_nonzero(f.coefficients) for f in fits.values())
    assert 0 < kept[8.0] < kept[1.0]


def test_one_feature_has_a_known_answer(spark):
    """Background at 0 and 1 alike: the share at 1 is the presences' share less the penalty."""
    data = [("x", float(i % 2), 0.0, 0.0, i < 40 and (i % 2 == 1 or i < 10)) for i in range(200)]
    found, fits = maxent.fit(frame(spark, data), ["g"], ["a"], "p", "L", 0.5)
    fit = fits["x",]
    share = fit.mean[0] - fit.penalty[0]
    assert fit.mean[0] == pytest.approx(20 / 25) and 1 / (1 + math.exp(-fit.coefficients[0])) == pytest.approx(share, abs=1e-5)


def test_scores_and_missing(spark):
    data = rows(400)
    f = frame(spark, data)
    _, fits = maxent.fit(f, ["g"], NAMES, "p", "LQH", 1.0)
    scored = maxent.project(f, fits, ["g"], NAMES, "LQH").collect()
    assert len(scored) == len(data)
    for r in scored:
        if r.g == "none" or r.a is None:
            assert r.score is None
            continue
        fit = fits[r.g,]
        x = (np.array([[r.a, r.b, r.c]]) - fit.low) / (fit.high - fit.low)
        eta = float((maxent.features(np.clip(x, 0, 1), "LQH") @ fit.coefficients)[0])
        assert r.score == pytest.approx(1 - math.exp(-math.exp(fit.entropy + eta - fit.log_z)), abs=1e-9) and 0 <= r.score <= 1


def test_objective_is_refused_where_it_cannot_settle(spark, monkeypatch):
    monkeypatch.setattr(maxent, "ROUNDS", 1)
    with pytest.raises(ValueError, match="converge"):
        maxent.fit(frame(spark, rows(200)), ["g"], NAMES, "p", "LQH", 0.1)
