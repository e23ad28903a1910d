"""Operators on small tables with exact expected values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import grid, keys, scores
from cellweave.operators import ensemble, ledger, models, ranking, sampling, selection, spatial, splits, validate, zonal


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize("a, b, w, want", [(0.0, 0.5, 0.5, 0.0), (0.0, 0.5, 0.0, 0.5), (0.7, 0.0, 1.0, 0.7), (None, 0.5, 0.5, None), (0.5, None, 1.0, None), (0.9, 0.1, 0.5, 0.3), (0.0, 0.0, 0.5, 0.0)])
def test_geometric(spark, a, b, w, want):
    got = one(spark, scores.geometric(lit(a), lit(b), w))
    assert got is None if want is None else got == pytest.approx(want)


def fused(spark, m, h, feasible, hj, **how):
    f = scores.fuse(lit(m), lit(h), F.lit(feasible), lit(hj), **how)
    return spark.range(1).select(*(c.alias(k) for k, c in f.items())).first()


def test_fuse(spark):
    r = fused(spark, 0.9, 0.1, 1, 1.0)
    assert (r.conservation, r.restoration) == (pytest.approx(0.3), pytest.approx(0.9))
    assert fused(spark, 0.9, 0.1, 1, 1.0, method="linear").conservation == pytest.approx(0.5)
    assert fused(spark, 0.5, 0.3, 1, 0.3, deficit="relative_degradation").restoration == 0.0
    assert fused(spark, 0.5, None, 1, 1.0).conservation is None
    assert fused(spark, 0.9, 0.0, 1, 0.0).restoration == 0.0 and fused(spark, 0.9, 0.1, 0, 1.0).restoration == 0.0
    assert one(spark, scores.relative_degradation(lit(0.3), lit(0.3))) == 0.0
    assert one(spark, scores.relative_degradation(lit(0.0), lit(0.0))) is None and one(spark, scores.relative_degradation(lit(None), lit(1.0))) is None
    with pytest.raises(ValueError):
        scores.fuse(lit(1), lit(1), lit(1), lit(1), deficit="other")


def test_zones(spark):
    rows = [(0.9, 0.9, 1.0), (0.9, 0.1, 1.0), (0.2, 0.9, 1.0), (0.2, 0.1, 1.0), (0.9, 0.0, 0.0), (None, 0.5, 1.0), (0.7, 0.7, 1.0)]
    got = [r.z for r in spark.createDataFrame(rows, "m double, h double, j double").select(scores.zone(F.col("m"), F.col("h"), F.lit(1), F.col("j")).alias("z")).collect()]
    assert got == [1, 2, 3, 4, 5, 0, 1]


@pytest.mark.parametrize("bad", [-0.01, 1.01, float("inf"), float("nan")])
def test_unit_interval_fails(spark, bad):
    with pytest.raises(Exception, match="outside"):
        one(spark, scores.checked_unit(lit(bad), "m"))
    assert one(spark, scores.checked_unit(lit(None), "m")) is None


def test_projection_inverts(spark):
    rows = spark.createDataFrame([(111.0, 34.8), (113.6, 34.9), (112.1, 35.4), (109.2, 33.0)], "lon double, lat double")
    e, n = grid.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = grid.to_degrees(F.col("e"), F.col("n"))
    got = rows.select("lon", "lat", e.alias("e"), n.alias("n")).select("*", lon.alias("x"), lat.alias("y")).collect()
    assert got[0].e == pytest.approx(500000, abs=1e-6)
    assert got[0].n == pytest.approx(0.9996 * meridian(34.8), abs=1e-3)
    for r in got:
        assert (r.x, r.y) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9))


def meridian(latitude):
    """Arc length from the equator by numerical integration."""
    f = 1 / 298.257223563
    e2 = f * (2 - f)
    phi = np.linspace(0, math.radians(latitude), 200_001)
    y = 6378137.0 * (1 - e2) / (1 - e2 * np.sin(phi) ** 2) ** 1.5
    return float(((y[1:] + y[:-1]) / 2).sum() * (phi[1] - phi[0]))


def test_grid(spark):
    g = grid.Grid(50, 4, 650_000.0, 3_870_000.0)
    assert one(spark, g.cell(lit(650_150.0), lit(3_869_750.0))) == 101
    assert one(spark, g.cell(lit(649_999.0), lit(3_869_750.0))) is None
    assert one(spark, grid.block(lit(-1.0), lit(999.0), 1000.0)) == "b-1_0"
    assert one(spark, grid.cell_name(F.lit(2), F.lit(7))) == "utm49_r2_c7"
    assert not g.aligned(grid.Grid(50, 4, 650_050.0, 3_870_000.0)) and g.aligned(g)
    with pytest.raises(Exception, match="outside the grid"):
        one(spark, g.index(F.lit(4), F.lit(0)))


def test_keys(spark):
    assert one(spark, keys.text_key(F.lit(" A b\tC\n"))) == "abc" and one(spark, keys.text_key(F.lit("  "))) is None
    day = F.to_date(F.lit("2021-12-05"))
    assert one(spark, keys.season(day)) == "winter" and one(spark, keys.season_year(day)) == 2022
    import hashlib

    assert one(spark, keys.seed_for(42, F.lit("spring/v0"))) == (42 + int(hashlib.sha256(b"spring/v0").hexdigest()[:8], 16)) % 2**32


def scored(spark, p, b):
    return spark.createDataFrame([(True, float(x)) for x in p] + [(False, float(x)) for x in b], "positive boolean, score double")


@pytest.mark.parametrize("p, b, want", [([0.8, 0.9], [0.1, 0.2], 1.0), ([0.5], [0.5], 0.5), ([0.1], [0.9], 0.0), ([0.5, 0.7], [0.5, 0.6], 0.625)])
def test_auc(spark, p, b, want):
    assert ranking.auc(scored(spark, p, b), [], "positive", "score").first().auc == pytest.approx(want)


def test_auc_without_one_class_is_null(spark):
    assert ranking.auc(scored(spark, [0.5], []), [], "positive", "score").first().auc is None


def test_spearman(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 2)], "a int, b int")
    assert ranking.spearman(rows, [], "a", "b").first().spearman == pytest.approx(0.5)
    assert ranking.spearman(rows.withColumn("c", F.lit(1)), [], "a", "c").first().spearman is None
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 40, 3000), rng.integers(0, 40, 3000)
    y = x + y

    def ranks(v):
        values, n = np.unique(v, return_counts=True)
        return (np.cumsum(n) - (n - 1) / 2)[np.searchsorted(values, v)]

    many = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "a int, b int")
    assert ranking.spearman(many, [], "a", "b").first().spearman == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1])


def test_top_share_cuts_ties_by_key(spark):
    rows = spark.createDataFrame([(i, 1.0 if i < 3 else 0.5) for i in range(10)], "cell_id int, s double")
    got = {r.cell_id for r in ranking.top_share(rows, [], "s", "cell_id", 0.5, "top").where("top").collect()}
    assert got == {0, 1, 2, 3, 4}


def test_screen():
    assert ranking.screen_by_correlation(["a", "b", "c"], {("a", "b"): 1.0, ("a", "c"): None, ("b", "c"): None}, {"c"}) == ["a"]
    with pytest.raises(ValueError):
        ranking.screen_by_correlation(["c"], {}, {"c"})


def test_omission_is_strict(spark):
    assert ranking.omission(scored(spark, [0.1, 0.2, 0.3, 0.4], [0.0]), [], "positive", "score", 0.0).first().omission == 0.0
    row = ranking.omission(scored(spark, [1, 2, 4, 8], []), [], "positive", "score", 0.1).first()
    assert row.threshold == pytest.approx(1.3) and row.omission == 0.25


def test_choice(spark):
    rows = [("v", "B0", 1.0, "L", 3, 0.90, 0.01, 0.02, 0.1, 9.0, 0.1), ("v", "B0", 2.0, "L", 3, 0.90, 0.01, 0.02, 0.1, 5.0, 0.1), ("v", "B0", 4.0, "L", 3, 0.895, 0.01, 0.01, 0.1, 5.0, 0.1), ("v", "B0", 0.5, "L", 3, 0.99, 0.01, 0.01, 0.5, 1.0, 0.1)]
    summary = spark.createDataFrame(rows, "variant string, background string, rm double, fc string, inner_folds int, mean_auc double, auc_sd double, auc_se double, mean_omission double, mean_complexity double, mean_abs_auc_gap double")
    got = selection.choose(summary, ["variant"], 0.2).first()
    assert got.rm == 4.0 and not got.omission_constraint_failed and got.selection_auc_band_lower == pytest.approx(0.88)
    assert selection.choose(summary, ["variant"], 0.05).first().omission_constraint_failed


def test_calibration_rank(spark):
    rows = [(m, f, s) for m, ss in (("a", (0.80, 0.81, 0.82)), ("b", (0.50, 0.51, 0.52))) for f, s in enumerate(ss)]
    frame = spark.createDataFrame(rows, "member_id string, fold int, score double")
    assert [r.member_id for r in selection.calibration_rank(frame).orderBy("rank").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="same three or more folds"):
        selection.calibration_rank(frame.where("NOT (member_id = 'b' AND fold = 2)")).collect()


def test_paired_uncertainty(spark):
    rows = [(1, 0, 0.1, 0.9), (1, 1, 0.9, 0.1), (2, 0, 0.5, None), (2, 1, 0.5, 0.5)]
    draws = spark.createDataFrame(rows, "cell int, member int, m double, h double").withColumns({"feasible": F.lit(1), "habitat_suitability": F.lit(1.0)})
    got = {r.cell: r for r in ensemble.paired_uncertainty(draws, ["cell"], 2).collect()}
    assert got[1].conservation_median == pytest.approx(0.3) and got[2].conservation_median is None and got[2].zone_agreement is None


def test_distances_against_brute_force(spark):
    cells = spatial.tile(spark, 40, 30)
    rng = np.random.default_rng(1)
    held = {(int(r), int(c)) for r, c in zip(rng.integers(0, 30, 12), rng.integers(0, 40, 12))}
    marked = spark.createDataFrame([(r, c) for r, c in held], "row long, col long")
    got = {(r.row, r.col) for r in spatial.buffer_exclusion(cells, marked, 450.0).collect()}
    limit = (450 + math.sqrt(2) * 100) / 100
    assert got == {(r, c) for r in range(30) for c in range(40) if min(math.hypot(r - a, c - b) for a, b in held) <= limit}
    assert {(r.row, r.col) for r in spatial.buffer_exclusion(cells, marked, 0.0).collect()} == held
    assert spatial.buffer_exclusion(cells, marked.limit(0), 450.0).count() == 0


def test_support_distance(spark):
    got = {(r.row, r.col): r.support_m for r in spatial.support_distance(spatial.tile(spark, 11, 11), 11, 11, 100.0, 5000.0).collect()}
    assert got[0, 0] == 0.0 and got[5, 5] == pytest.approx(600 - math.sqrt(2) * 100)


def test_smoothing_against_dense(spark):
    values = spark.createDataFrame([(10, 10, 2.0), (12, 9, 5.0)], "row int, col int, value double")
    got = {(r.row, r.col): r.density for r in spatial.smooth(values, 1.5).collect()}
    k = spatial.gaussian_kernel(1.5)
    w = lambda d: k[abs(d)] if abs(d) < len(k) else 0.0
    for r in range(4, 18):
        for c in range(4, 18):
            assert got.get((r, c), 0.0) == pytest.approx(2 * w(r - 10) * w(c - 10) + 5 * w(r - 12) * w(c - 9), abs=1e-15)
    assert k[0] + 2 * sum(k[1:]) == pytest.approx(1)


def test_merged_blocks_and_polygon(spark):
    pairs = spark.createDataFrame([("s1", "b1"), ("s1", "b2"), ("s2", "b2"), ("s2", "b9"), ("s3", "b5"), (None, "b6")], "site string, block string")
    assert {r.block: r.root for r in spatial.merge_linked_blocks(pairs).collect()} == {"b1": "b1", "b2": "b1", "b9": "b1", "b5": "b5"}
    from cellweave.sources.files import boundary_edges

    ring = [[0, 0], [4000, 0], [4000, 3000], [0, 3000], [0, 0]]
    hole = [[1000, 1000], [2000, 1000], [2000, 2000], [1000, 2000], [1000, 1000]]
    edges = boundary_edges(spark, {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [ring, hole]}})
    points = spark.createDataFrame([(1, 500.0, 500.0), (2, 1500.0, 1500.0), (3, 4100.0, 100.0), (4, 2500.0, 1500.0)], "id int, x double, y double")
    assert sorted(r.id for r in spatial.inside_polygon(points, edges, ["id"]).collect()) == [1, 4]


def test_sampling(spark):
    cells = spatial.tile(spark, 20, 20)
    fit = cells.where("col < 10")
    seen = spark.createDataFrame([(0, 0, 4), (2, 5, 2)], "row long, col long, visits long")
    weighted = sampling.density_weights(fit, seen, 2.0, 0.1)
    assert weighted.agg(F.sum("weight")).first()[0] == pytest.approx(1, abs=1e-6)
    drawn = [r.cell_id for r in sampling.weighted_background(weighted, 30, 3).collect()]
    assert len(set(drawn)) == 30 and sorted(drawn) == sorted(r.cell_id for r in sampling.weighted_background(weighted, 30, 3).collect())
    assert sampling.uniform_background(fit, 1000, 1).count() == 200
    flat = sampling.density_weights(fit, seen.limit(0), 2.0, 0.1)
    assert flat.select("weight").distinct().count() == 1
    cube = sampling.latin_hypercube(spark, {"weight:a": (0.0, 1.0)}, 16, 1).select(F.floor(F.col("value") * 16).alias("s"))
    assert sorted(r.s for r in cube.collect()) == list(range(16))
    plan = sampling.crossfit_plan(spark.createDataFrame([(f"g{i}",) for i in range(7)], "g string"), "g", 3, 42).collect()
    outer = {r.outer_group for r in plan}
    assert None in outer and len(outer) == 8
    assert all((r.role == "held_out") == (r.outer_group == r.group_id and r.outer_group is not None) for r in plan)


def test_split_plan(spark):
    cells = spatial.tile(spark, 60, 60).select("*", (650000 + (F.col("col") + 0.5) * 100).alias("x"), (3870000 - (F.col("row") + 0.5) * 100).alias("y"), (F.col("cell_id") != 0).alias("valid"))
    presence = cells.where("row % 2 = 0 AND col % 2 = 0 AND valid").select(F.lit("spring").alias("season"), "cell_id")
    sites = spark.createDataFrame([("a", 5), ("a", 1500)], "site string, cell_id long")
    folds, parts = splits.split_plan(cells, presence, ["spring"], splits.Settings(trials=8), sites)
    folds = folds.cache()
    assert splits.plan_leaks(folds, parts).where("n_violations > 0").count() == 0
    held = {}
    for r in folds.join(cells.select("cell_id", "row", "col"), "cell_id").collect():
        held.setdefault((r.outer, r.inner), {}).setdefault(r.role, []).append((r.row, r.col, r.cell_id))
    for roles in held.values():
        v, f = np.array(roles["validation"])[:, :2], np.array(roles["fit"])[:, :2]
        d = np.sqrt(((v[:, None] - f[None]) ** 2).sum(axis=2)).min()
        assert d * 100 > 100 + math.sqrt(2) * 100
        assert all(c != 0 for role in roles.values() for _, _, c in role)
    counts = splits.fold_counts(folds, presence, ["spring"], 1).collect()
    assert all(r.enough for r in counts)


def test_ledger(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", 1), (4, None, 1)], "id int, k string, v int")
    assert {r.id for r in ledger.duplicate_flags(rows, ["k", "v"]).where("is_duplicate").collect()} == {1, 2}
    assert [r.k for r in ledger.collisions(rows, "k").collect()] == ["a"]
    members = spark.createDataFrame([("e", "c2", "fit"), ("e", "c1", "validation"), ("f", "c1", "fit")], "event string, cell string, role string")
    got = {r.event: r for r in ledger.membership_summary(members, "event", ["cell", "role"]).collect()}
    assert got["e"].conflict and got["e"].cell_set == ["c1", "c2"] and not got["f"].conflict
    queue = ledger.review_queue(spark.createDataFrame([("e",), ("g",)], "event string"), ledger.membership_summary(members, "event", ["role"]), "event")
    assert {(r.event, r.review_status, r.eligible, r.target) for r in queue.collect()} == {("e", "conflict", False, None), ("g", "no_membership", False, None)}
    parts = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2)], "k string, part int")
    assert [r.k for r in ledger.contiguous(parts, ["k"], "part").collect()] == ["b"]


def sample(**change):
    row = {"sample_id": "1", "site_id": "s", "group_id": "g", "year": 2020, "season": "spring", "m": 0.5, "h": 0.4, "habitat_suitability": 0.6, "u_m": 0.1, "u_h": 0.1, "feasible": 1}
    return row | change


@pytest.mark.parametrize("change, rule", [({"m": 1.2}, "m_outside_unit"), ({"m": None}, "m_outside_unit"), ({"sample_id": " "}, "blank_sample_id"), ({"season": "monsoon"}, "unknown_season"), ({"h": 0.7}, "h_above_reference"), ({"feasible": 2}, "feasible_not_binary"), ({"u_m": -1.0}, "u_m_negative"), ({"year": None}, "missing_year")])
def test_sample_rules(spark, change, rule):
    schema = "sample_id string, site_id string, group_id string, year int, season string, m double, h double, habitat_suitability double, u_m double, u_h double, feasible int"
    frame = spark.createDataFrame([tuple(sample(**change).values())], schema)
    found = validate.sample_violations(frame)
    assert {r.rule for r in found.where("n_violations > 0").collect()} == {rule}
    with pytest.raises(validate.ValidationError, match=rule):
        validate.require(found)
    twice = spark.createDataFrame([tuple(sample().values())] * 2, schema)
    assert {r.rule for r in validate.sample_violations(twice).where("n_violations > 0").collect()} == {"repeated_sample_id", "repeated_natural_key"}
    with pytest.raises(validate.ValidationError, match="missing columns"):
        validate.sample_violations(frame.drop("m"))


def test_models(spark):
    assert models.assignment([[1, 0, 0], [0, 0, 2], [0, 3, 0]]) == [0, 2, 1]
    rng = np.random.default_rng(0)
    gain = rng.random((6, 6))
    import itertools

    best = max(sum(gain[i][p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
    assert sum(gain[i][j] for i, j in enumerate(models.assignment(gain.tolist()))) == pytest.approx(best)
    frame = spark.createDataFrame([(1.0 if i < 2 else 0.0, 1.0) for i in range(10)], "y double, w double")
    assert models.ridge_logistic(frame, [], "y")["intercept"] == pytest.approx(math.log(0.25), abs=1e-3)
    weighted = frame.withColumn("w", F.when(F.col("y") == 1, 4.0).otherwise(1.0))
    assert models.ridge_logistic(weighted, [], "y", "w")["intercept"] == pytest.approx(0, abs=1e-3)
    x = rng.normal(size=(400, 2))
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + x[:, 0] - 2 * x[:, 1])))).astype(float)
    fit = models.ridge_logistic(spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double"), ["a", "b"], "y", ridge=1e-3)
    eta = fit["intercept"] + x @ np.array([fit["a"], fit["b"]])
    gradient = x.T @ (1 / (1 + np.exp(-eta)) - y) + 1e-3 * np.array([fit["a"], fit["b"]])
    assert np.abs(gradient).max() < 1e-3


def test_gate_gradient_and_round_trip(spark):
    rng = np.random.default_rng(1)
    gate = models.DualGate.fresh(np.zeros(6), np.ones(6), 3)
    assert gate.size() == 2596
    gate.parameters["out_w"] = rng.normal(size=(32, 4)) * 0.3
    x = rng.random((20, 6))
    x[0, 0], x[1, 1] = 0.0, 1.0
    eligible = rng.random(20) < 0.7
    targets = np.where(rng.random((20, 2)) < 0.2, np.nan, rng.random((20, 2)))
    counts = (~np.isnan(targets)).sum(axis=0)
    loss = lambda: gate.gradient(x, eligible, targets, counts, 20, 0.01)[0]
    _, g = gate.gradient(x, eligible, targets, counts, 20, 0.01)
    for name, value in gate.parameters.items():
        flat = value.reshape(-1)
        for i in rng.integers(0, flat.size, 4):
            keep, step = flat[i], 1e-6
            flat[i] = keep + step
            up = loss()
            flat[i] = keep - step
            down = loss()
            flat[i] = keep
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=1e-7), name
    again = models.DualGate.load(gate.dump())
    assert np.abs(again.predict(x, eligible)[0] - gate.predict(x, eligible)[0]).max() < 1e-12
    assert gate.predict(x, eligible)[0][0].tolist() == [0.0, 0.0]
    with pytest.raises(ValueError):
        models.DualGate.load(gate.dump() | {"features": ["other"]})
    rows = [(*map(float, f), bool(e), "train" if i < 15 else "validation", *(None if math.isnan(t) else float(t) for t in ts)) for i, (f, e, ts) in enumerate(zip(x, eligible, targets))]
    schema = ", ".join(f"{f} double" for f in models.FEATURES) + ", eligible boolean, role string, target_protection double, target_restoration double"
    frame = spark.createDataFrame(rows, schema)
    local = models.train_gate(frame, {"epochs": 3, "dropout": 0.0})
    spread = models.train_gate(frame, {"epochs": 3, "dropout": 0.0}, driver_rows=1)
    assert all(np.allclose(local.parameters[k], spread.parameters[k], atol=1e-9) for k in local.parameters)


def test_gate_is_the_same_at_any_size(spark):
    rng = np.random.default_rng(6)
    rows = [(*map(float, rng.random(6)), True, "train" if i < 12 else "validation", float(rng.random()), None if i % 5 == 0 else float(rng.random())) for i in range(40)]
    schema = ", ".join(f"{f} double" for f in models.FEATURES) + ", eligible boolean, role string, target_protection double, target_restoration double"
    frame = spark.createDataFrame(rows, schema).repartition(4)
    config = {"epochs": 4, "dropout": 0.5}
    local = models.train_gate(frame, config)
    # Beyond the bound: the validation rows only, and all rows.
    for bound in (20, 1):
        other = models.train_gate(frame, config, driver_rows=bound)
        assert all(np.allclose(local.parameters[k], other.parameters[k], atol=1e-9) for k in local.parameters)
        assert np.allclose([list(h.values()) for h in local.history], [list(h.values()) for h in other.history], atol=1e-9)


def test_zonal(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.1), (1, 0.5, 0.5), (2, 0.1, 0.9)], "label int, a double, b double")
    got = {(r.label, r.predicted): (r.n, r.n_ties) for r in zonal.confusion(rows, "label", ["a", "b"]).collect()}
    assert got == {(1, 1): (2, 1), (2, 2): (1, 0)}
    designs = zonal.scenario_designs(spark, [("a", 100.0, 0.5), ("b", 200.0, 0.5), ("c", 300.0, 0.5)], 0.5)
    assert designs.select("scenario").distinct().count() == 18
    assert all(r.s == pytest.approx(1) for r in designs.groupBy("scenario").agg(F.sum("weight").alias("s")).collect())


def test_resample(spark):
    cells = spatial.tile(spark, 4, 4).withColumn("v", F.when(F.col("cell_id") != 5, (F.col("row") * 10 + F.col("col")).cast("double")))
    source = grid.Grid(4, 4, 0.0, 400.0)
    same = {(r.row, r.col): r.v for r in spatial.resample(cells, source, source, "v").collect()}
    assert same[2, 3] == 23.0 and same[1, 1] is None
    half = {(r.row, r.col): r.v for r in spatial.resample(cells, source, grid.Grid(2, 2, 0.0, 400.0, 200.0), "v").collect()}
    assert half[1, 1] == pytest.approx(27.5) and half[0, 0] == pytest.approx((0 + 1 + 10) / 3)
    near = {(r.row, r.col): r.v for r in spatial.resample(cells, source, grid.Grid(2, 2, 10.0, 390.0, 200.0), "v", "nearest").collect()}
    assert near[0, 0] is None and near[1, 1] == 33.0


def test_below_with_many_buckets(spark, monkeypatch):
    """Two groups, one much larger, ordered over hundreds of buckets."""
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 10)
    rows = [("big", float(i * i % 4001)) for i in range(2000)] + [("small", float(i)) for i in range(30)] + [("one", 5.0)]
    got = {(r.g, r.v): r.rank for r in ranking.average_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "rank").collect()}
    for g, v in set(rows):
        mine = [x for k, x in rows if k == g]
        assert got[g, v] == sum(x < v for x in mine) + (mine.count(v) + 1) / 2


def test_constraint_audit_finds_wrong_flags_and_missing_folds(spark):
    winners = spark.createDataFrame([("a", "B0", 2, 0.1, False), ("b", "B0", 2, 0.5, False), ("c", "B1", 3, 0.5, True)], "season string, background string, inner_folds long, mean_omission double, omission_constraint_failed boolean")
    evidence = spark.createDataFrame([("a", "B0", "hit_limit"), ("a", "B0", "converged"), ("b", "B1", "converged"), ("c", "B1", "unknown")], "season string, background string, category string")
    found = selection.constraint_audit(winners, evidence, ["season"], ["season", "background"], 0.2)
    got = {r.season: (r.n_evidence, r.n_hit_limit, r.n_converged, r.n_unknown, r.flag_consistent, r.evidence_complete) for r in found.collect()}
    assert got == {"a": (2, 1, 1, 0, True, True), "b": (0, 0, 0, 0, False, False), "c": (1, 0, 0, 1, True, False)}


def test_gate_reads_its_rows_once_and_counts_equal_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(*map(float, rng.random(4)), 0.0, 1.0, True, "validation" if i % 4 == 0 else "train", float(rng.random()), None if i % 3 else float(rng.random())) for i in range(60)]
    kinds = "m double, h double, u_m double, u_h double, season_sin double, season_cos double, eligible boolean, role string, target_protection double, target_restoration double"
    seen = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    once = spark.createDataFrame(rows, kinds)
    frame = once.union(once).union(once).mapInArrow(watched, kinds)
    spread = models.train_gate(frame, {"epochs": 3, "seed": 5}, driver_rows=1)
    assert seen.value == 180
    local, single = models.train_gate(frame, {"epochs": 3, "seed": 5}), models.train_gate(once, {"epochs": 3, "seed": 5})
    for k, v in spread.parameters.items():
        assert np.allclose(v, local.parameters[k], atol=1e-6) and np.allclose(v, single.parameters[k], atol=1e-6)
    assert [h["validation_mse"] for h in spread.history] == pytest.approx([h["validation_mse"] for h in single.history])


def test_normal_distribution_by_table():
    x = np.r_[np.linspace(-12, 12, 20_011), 1 / 2048, -0.0]
    cdf, density = models._normal(x)
    want = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in x])
    assert np.abs(cdf - want).max() < 1e-15 and np.abs(density - np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)).max() < 1e-15


def _drifting(spark, columns: str):
    """1,000 rows whose values are other ones each time they are computed."""
    def draw(i):
        import random

        return i + random.random() / 2

    fresh = F.udf(draw, "double").asNondeterministic()
    values = [fresh("id").alias(c) for c in columns]
    return spark.range(1000).select("id", *values)


def test_spearman_takes_ranks_from_the_rows_it_counts(spark):
    got = ranking.spearman(_drifting(spark, "ab"), [], "a", "b").first()
    assert got.n == 1000 and got.spearman == pytest.approx(1.0)


def test_top_share_marks_the_rows_it_counted(spark):
    got = ranking.top_share(_drifting(spark, "a"), [], "a", "id", 0.1, "inside").where("inside")
    assert sorted(r.id for r in got.collect()) == list(range(900, 1000))


def test_footprints_by_member_equal_the_listed_ones(spark):
    from cellweave.operators import provenance

    rng = np.random.default_rng(8)
    held = [(f"m{rng.integers(4)}", f"s{rng.integers(60)}") for _ in range(90)]
    plan = [(f"a{i}", f"m{j}") for i in range(4) for j in range(4) if (i + j) % 3]
    groups = [(f"a{i}", f"g{j}") for i in range(4) for j in range(5) if (i * j) % 3 == 0]
    asked = [(f"s{i}", f"g{i % 6}" if i % 11 else None, f"a{i % 5}") for i in range(0, 60, 2)] + [("s4", "g1", "a4"), ("s4", "g2", "a1")]
    samples = spark.createDataFrame(asked, "sample_id string, group_id string, artifact string")
    parts = [spark.createDataFrame(plan, "artifact string, member string"), spark.createDataFrame(held, "member string, sample_id string"), spark.createDataFrame(groups, "artifact string, group_id string")]
    listed = {(a, "fit", "sample", s) for a, m in plan for n, s in held if m == n} | {(a, "fit", "group", g) for a, g in groups}
    footprints = spark.createDataFrame(sorted(listed), "artifact string, stage string, kind string, id string")
    same = lambda a, b: sorted(map(str, a.select(*b.columns).collect())) == sorted(map(str, b.collect()))
    assert same(provenance.leaks_by_member(samples, *parts), provenance.leaks(samples, footprints))
    assert same(provenance.consistency_by_member(samples, *parts), provenance.footprint_consistency(samples, footprints))


@pytest.mark.parametrize("name, view", [("constant_weights", "targets"), ("footprint_consistency", "units"), ("provenance_leaks", "units"), ("topk_overlap", "members")])
def test_queries_compute_their_view_once(spark, monkeypatch, name, view):
    from cellweave.plans.registry import QUERIES
    from cellweave.sources.bridge import Bridge

    seen, made = spark.sparkContext.accumulator(0), getattr(Bridge, view)

    def watched(self):
        rows = made(self)

        def run(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return rows.mapInArrow(run, rows.schema)

    sf = "/root/testdata/sf0.001"
    n = made(Bridge(spark, sf)).count()
    monkeypatch.setattr(Bridge, view, watched)
    QUERIES[name](spark, sf).collect()
    assert 0 < seen.value <= n
