"""Queries of the scoring core: fusion, zones, controls, envelopes, validation, grids of parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import scores
from cellweave.functions.keys import seed_for
from cellweave.operators import ensemble, models, validate, zonal
from cellweave.plans.views import with_views
from cellweave.sinks import checkpointed
from cellweave.sources.bridge import Bridge



class _Inputs:
    """The scoring inputs as columns, made when a session exists."""

    def __getattr__(self, name: str):
        return F.col({"m": "m", "h": "h", "feasible": "feasible", "reference": "habitat_suitability"}[name])


U = _Inputs()


def r6(column, name: str):
    """Rounded for comparison between engines; -0.0 becomes 0.0."""
    return (F.round(column, 6) + F.lit(0.0)).alias(name)


def geometric_sql(a: str, b: str, w: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {w} = 1 THEN {a} WHEN {w} = 0 THEN {b} WHEN ({a} = 0 AND {w} > 0) OR ({b} = 0 AND {w} < 1) THEN 0.0::DOUBLE "
        f"ELSE exp({w} * ln(greatest({a}, 1e-8::DOUBLE)) + (1.0::DOUBLE - {w}) * ln(greatest({b}, 1e-8::DOUBLE))) END"
    )


ZONE_SQL = """CASE WHEN m IS NULL OR h IS NULL OR feasible IS NULL OR habitat_suitability IS NULL THEN 0 WHEN m >= 0.7 AND h >= 0.7 THEN 1 WHEN m < 0.7 AND h >= 0.7 THEN 3
WHEN m >= 0.7 AND feasible = 1 AND habitat_suitability > 0 THEN 2 WHEN m >= 0.7 THEN 5 ELSE 4 END::TINYINT"""


def fuse_sql(method: str, deficit: str = "low_hq") -> str:
    gap = "(1.0::DOUBLE - h)" if deficit == "low_hq" else "(CASE WHEN habitat_suitability = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE - least(greatest(h / habitat_suitability, 0.0::DOUBLE), 1.0::DOUBLE) END)"
    how = {"geometric": lambda a, b: geometric_sql(a, b, "0.5::DOUBLE"), "linear": lambda a, b: f"0.5::DOUBLE * {a} + 0.5::DOUBLE * {b}", "minimum": lambda a, b: f"least({a}, {b})"}[method]
    return with_views(f"""
WITH f AS (
  SELECT *, m IS NULL OR h IS NULL AS gone, feasible = 1 AND habitat_suitability > 0 AS ok FROM units
)
SELECT sample_id, CASE WHEN NOT gone THEN round({how("m", "h")}, 6) + 0.0::DOUBLE END AS conservation,
       CASE WHEN gone THEN NULL WHEN NOT ok THEN 0.0::DOUBLE ELSE round({how("m", gap)}, 6) + 0.0::DOUBLE END AS restoration, CASE WHEN NOT gone THEN ok END AS eligible
FROM f""", "units")


def fuse_query(method: str, deficit: str = "low_hq"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = scores.fuse(U.m, U.h, U.feasible, U.reference, method=method, deficit=deficit)
        return Bridge(spark, sf_dir).units().select("sample_id", r6(f["conservation"], "conservation"), r6(f["restoration"], "restoration"), f["eligible"].alias("eligible"))

    return run


def zones_by_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validated units, scored, classified and counted by season and zone."""
    units = Bridge(spark, sf_dir).units()
    f = scores.fuse(scores.checked_unit(U.m, "m"), scores.checked_unit(U.h, "h", False), U.feasible, scores.checked_unit(U.reference, "habitat_suitability", False))
    marked = units.select("season", scores.zone(U.m, U.h, U.feasible, U.reference).alias("zone"), f["conservation"].alias("c"), f["restoration"].alias("r"))
    return marked.groupBy("season", "zone").agg(F.count(F.lit(1)).alias("n_units"), r6(F.avg("c"), "conservation"), r6(F.avg("r"), "restoration"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate's inputs, in millionths."""
    made = scores.features(U.m, U.h, F.col("u_m"), F.col("u_h"), F.col("season"))
    return Bridge(spark, sf_dir).units().select("sample_id", *(F.round(v.cast("double") * 1000, 0).cast("long").alias(k) for k, v in made.items()))


def control_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared errors of the fixed controls by role, target and control."""
    t = Bridge(spark, sf_dir).targets()
    parts = []
    for target, factor in (("target_protection", U.h), ("target_restoration", 1.0 - U.h)):
        cs = scores.controls(U.m, factor, 0.6, 0.4)
        stacked = F.explode(F.array(*(F.struct(F.lit(n).alias("control"), c.alias("score")) for n, c in cs.items())))
        parts.append(t.select("role", F.lit(target).alias("target"), F.col(target).alias("y"), stacked.alias("c")))
    rows = parts[0].unionByName(parts[1]).select("role", "target", "y", "c.control", "c.score").where("y IS NOT NULL AND score IS NOT NULL")
    error = F.col("score") - F.col("y")
    return rows.groupBy("role", "target", "control").agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(error * error)), "rmse"), r6(F.avg(F.abs(error)), "mae"))


def envelope_by_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Bridge(spark, sf_dir).targets()
    rows = t.select(F.explode(F.array(
        F.struct(F.lit("protection").alias("target"), scores.envelope_residual(F.col("target_protection"), U.m, U.h, 0.1).alias("residual")),
        F.struct(F.lit("restoration").alias("target"), scores.envelope_residual(F.col("target_restoration"), U.m, 1.0 - U.h, 0.1).alias("residual")),
    )).alias("e")).select("e.*").where("residual IS NOT NULL")
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), r6(F.avg((F.col("residual") > 1e-6).cast("double")), "outside_share"), r6(F.sqrt(F.avg(F.col("residual") * F.col("residual"))), "rmse"))


def unit_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.sample_violations(Bridge(spark, sf_dir).targets(), training=True)


def target_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Bridge(spark, sf_dir).targets()
    eligible = (U.feasible == 1) & (U.reference > 0)
    return t.groupBy("role").agg(
        F.count("target_protection").alias("n_protection"), F.count("target_restoration").alias("n_restoration"),
        F.count_if((F.col("target_restoration") > 0) & ~eligible).alias("n_positive_not_eligible"), (F.count("target_protection") >= 20).alias("enough_protection"),
    )


def detection_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zonal.detection_grid(spark, [0.1, 0.25, 0.5, 0.75], [1, 2, 3, 5, 8]).select("p", "k", r6(F.col("detection"), "detection"))


def scenario_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = zonal.scenario_designs(spark, [("urban", 2000.0, 0.8), ("road", 1000.0, 0.5), ("crop", 500.0, 0.3)], 0.5)
    return made.select("scenario", "threat", "max_dist", r6(F.col("weight"), "weight"), "half_saturation")


def scope_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Bridge(spark, sf_dir).candidates().select("season", "variant").distinct()
    name = F.concat_ws("/", "season", "variant")
    return c.select(name.alias("scope"), seed_for(42, name).alias("seed"))


def paired_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members pair a score of their own with the cell's habitat layers."""
    b = Bridge(spark, sf_dir)
    cells = b.cells().select("cell_id", F.when(F.col("lucode") == 1, 0.0).otherwise(F.col("size") / 50.0).alias("habitat_suitability"), "light", F.when(F.col("lucode") == 2, 0).otherwise(1).alias("feasible"))
    draws = b.members().join(cells, "cell_id").select("season", "cell_id", "member", F.col("score").alias("m"), F.round(F.col("habitat_suitability") * (1.0 - F.col("light") * (F.col("member") + 1) / 3.0), 9).alias("h"), "feasible", "habitat_suitability")
    found = ensemble.paired_uncertainty(draws, ["season", "cell_id"], 3)
    return found.select("season", "cell_id", *(r6(F.col(c), c) for c in found.columns[2:8]), "zone", r6(F.col("zone_agreement"), "zone_agreement"))


def constant_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted control weights; the geometric ones by search, in hundredths."""
    t = Bridge(spark, sf_dir).targets().where("role = 'train'").select("target_protection", "target_restoration", "m", "h", (1.0 - U.h).alias("low"))
    t = checkpointed(t)  # each round of the search reads these rows
    rows = [(target, method, round(models.constant_weight(t, target, "m", factor, method), 2)) for target, factor in (("target_protection", "h"), ("target_restoration", "low")) for method in ("linear", "geometric")]
    return spark.createDataFrame(rows, "target string, method string, weight double")


def gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a gate trained on the exercise targets, with its two weights."""
    t = Bridge(spark, sf_dir).targets()
    made = scores.features(U.m, U.h, F.col("u_m"), F.col("u_h"), F.col("season"))
    angles = {k: made[k].cast("double") for k in ("season_sin", "season_cos")}
    rows = t.withColumns(angles | {"eligible": (U.feasible == 1) & (U.reference > 0)})
    gate = models.train_gate(rows, {"epochs": 60})
    return models.apply_gate(rows, gate, ["sample_id"])


QUERIES = {
    "zones_by_season": zones_by_season, "fuse_geometric": fuse_query("geometric"), "fuse_linear": fuse_query("linear"), "fuse_minimum": fuse_query("minimum"),
    "fuse_relative_degradation": fuse_query("geometric", "relative_degradation"), "gate_features": features, "control_scores_long": control_scores_long, "envelope_by_target": envelope_by_target,
    "unit_rule_violations": unit_rule_violations, "target_eligibility": target_eligibility, "detection_grid": detection_grid, "scenario_designs": scenario_designs, "scope_seeds": scope_seeds,
    "paired_uncertainty": paired_uncertainty, "constant_weights": constant_weights, "gate_scores": gate_scores,
}

_PAIRS = " UNION ALL ".join(
    f"SELECT role, '{target}' AS target, {target} AS y, '{name}' AS control, {sql} AS score FROM targets"
    for target, factor in (("target_protection", "h"), ("target_restoration", "(1.0::DOUBLE - h)"))
    for name, sql in (
        ("m_only", "m"), ("factor_only", f"CASE WHEN m IS NOT NULL THEN {factor} END"), ("geometric_half", geometric_sql("m", factor, "0.5::DOUBLE")), ("linear_half", f"0.5::DOUBLE * m + 0.5::DOUBLE * {factor}"),
        ("geometric_fitted", geometric_sql("m", factor, "0.6::DOUBLE")), ("linear_fitted", f"0.4::DOUBLE * m + (1.0::DOUBLE - 0.4::DOUBLE) * {factor}"), ("minimum", f"CASE WHEN m IS NOT NULL THEN least(m, {factor}) END"),
    )
)


def _envelope(name: str, target: str, factor: str) -> str:
    a, b = geometric_sql("m", factor, "0.1::DOUBLE"), geometric_sql("m", factor, "(1.0::DOUBLE - 0.1::DOUBLE)")
    return f"SELECT '{name}' AS target, greatest(least({a}, {b}) - {target}, {target} - greatest({a}, {b}), 0.0::DOUBLE) AS residual FROM targets WHERE {target} IS NOT NULL AND m IS NOT NULL"


def _rules() -> str:
    checks = {f"blank_{c}": f"{c} IS NULL OR trim({c}) = ''" for c in ("sample_id", "site_id", "group_id")}
    checks |= {"missing_year": "year IS NULL", "unknown_season": "season IS NULL OR season NOT IN ('spring', 'summer', 'autumn', 'winter')"}
    checks |= {f"{c}_outside_unit": f"{c} IS NULL OR NOT {c} BETWEEN 0 AND 1" for c in ("m", "h", "habitat_suitability")}
    checks |= {f"{c}_negative": f"{c} IS NULL OR {c} < 0" for c in ("u_m", "u_h")}
    checks |= {"feasible_not_binary": "feasible IS NULL OR feasible NOT IN (0, 1)", "h_above_reference": "h > habitat_suitability + 1e-6", "unknown_role": "role IS NULL OR role NOT IN ('train', 'validation', 'test')"}
    checks |= {f"{c}_outside_unit": f"NOT coalesce({c}, 0) BETWEEN 0 AND 1" for c in ("target_protection", "target_restoration")}
    parts = [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS n_violations FROM targets" for n, c in checks.items()]
    parts.append("SELECT 'repeated_sample_id', count(*) FROM (SELECT 1 FROM targets GROUP BY sample_id HAVING count(*) > 1)")
    parts.append("SELECT 'repeated_natural_key', count(*) FROM (SELECT 1 FROM targets GROUP BY site_id, year, season HAVING count(*) > 1)")
    return " UNION ALL ".join(parts)


ORACLE = {
    "zones_by_season": with_views(f"""
SELECT season, {ZONE_SQL} AS zone, count(*) AS n_units, round(avg({geometric_sql("m", "h", "0.5::DOUBLE")}), 6) + 0.0::DOUBLE AS conservation,
       round(avg(CASE WHEN m IS NULL THEN NULL WHEN feasible = 1 AND habitat_suitability > 0 THEN {geometric_sql("m", "(1.0::DOUBLE - h)", "0.5::DOUBLE")} ELSE 0.0::DOUBLE END), 6) + 0.0::DOUBLE AS restoration
FROM units GROUP BY 1, 2""", "units"),
    "fuse_geometric": fuse_sql("geometric"), "fuse_linear": fuse_sql("linear"), "fuse_minimum": fuse_sql("minimum"), "fuse_relative_degradation": fuse_sql("geometric", "relative_degradation"),
    "gate_features": with_views("""
SELECT sample_id, round(m::FLOAT::DOUBLE * 1000)::BIGINT AS m, round(h::FLOAT::DOUBLE * 1000)::BIGINT AS h, round(u_m::FLOAT::DOUBLE * 1000)::BIGINT AS u_m, round(u_h::FLOAT::DOUBLE * 1000)::BIGINT AS u_h,
       CASE season WHEN 'summer' THEN 1000 WHEN 'winter' THEN -1000 ELSE 0 END::BIGINT AS season_sin, CASE season WHEN 'spring' THEN 1000 WHEN 'autumn' THEN -1000 ELSE 0 END::BIGINT AS season_cos FROM units""", "units"),
    "control_scores_long": with_views(f"SELECT role, target, control, count(*) AS n, round(sqrt(avg((score - y) * (score - y))), 6) + 0.0::DOUBLE AS rmse, round(avg(abs(score - y)), 6) + 0.0::DOUBLE AS mae FROM ({_PAIRS}) WHERE y IS NOT NULL AND score IS NOT NULL GROUP BY ALL", "targets"),
    "envelope_by_target": with_views(f"""
SELECT target, count(*) AS n, round(avg((residual > 1e-6)::INT), 6) + 0.0::DOUBLE AS outside_share, round(sqrt(avg(residual * residual)), 6) + 0.0::DOUBLE AS rmse
FROM ({_envelope("protection", "target_protection", "h")} UNION ALL {_envelope("restoration", "target_restoration", "(1.0::DOUBLE - h)")}) GROUP BY 1""", "targets"),
    "unit_rule_violations": with_views(_rules(), "targets"),
    "target_eligibility": with_views("""
SELECT role, count(target_protection) AS n_protection, count(target_restoration) AS n_restoration,
       count(*) FILTER (WHERE target_restoration > 0 AND NOT (feasible = 1 AND habitat_suitability > 0)) AS n_positive_not_eligible, count(target_protection) >= 20 AS enough_protection FROM targets GROUP BY 1""", "targets"),
    "detection_grid": "SELECT p, k, round(1 - pow(1 - p, k), 6) + 0.0::DOUBLE AS detection FROM (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75]) AS p), (SELECT unnest([1, 2, 3, 5, 8])::INT AS k)",
    "scenario_designs": """
WITH t AS (SELECT * FROM (VALUES ('urban', 2000.0::DOUBLE, 0.8::DOUBLE), ('road', 1000.0::DOUBLE, 0.5::DOUBLE), ('crop', 500.0::DOUBLE, 0.3::DOUBLE)) v(threat, d, w)),
s AS (
  SELECT 'base' AS scenario, NULL AS changed, NULL AS field, 1.0::DOUBLE AS f, 1.0::DOUBLE AS k
  UNION ALL SELECT threat || '_' || field || '_' || tag, threat, field, f, 1.0::DOUBLE FROM t, (VALUES ('weight'), ('max_dist')) a(field), (VALUES ('half', 0.5::DOUBLE), ('double', 2.0::DOUBLE)) b(tag, f)
  UNION ALL SELECT threat || '_out', threat, 'out', 0.0::DOUBLE, 1.0::DOUBLE FROM t
  UNION ALL SELECT 'half_saturation_' || tag, NULL, NULL, 1.0::DOUBLE, f FROM (VALUES ('half', 0.5::DOUBLE), ('double', 2.0::DOUBLE)) b(tag, f)
), j AS (
  SELECT scenario, threat, CASE WHEN changed = threat AND field = 'max_dist' THEN d * f ELSE d END AS d, CASE WHEN changed = threat AND field = 'weight' THEN w * f ELSE w END AS w, k * 0.5 AS half_saturation
  FROM s, t WHERE NOT coalesce(field = 'out' AND changed = threat, false)
), b AS (SELECT *, w / greatest(1.0::DOUBLE, max(w) OVER (PARTITION BY scenario)) AS b FROM j)
SELECT scenario, threat, d AS max_dist, round(b / sum(b) OVER (PARTITION BY scenario), 6) + 0.0::DOUBLE AS weight, half_saturation FROM b""",
    "scope_seeds": with_views("SELECT scope, (42 + ('0x' || substr(sha256(scope), 1, 8))::BIGINT) % 4294967296 AS seed FROM (SELECT DISTINCT season || '/' || variant AS scope FROM candidates)", "candidates"),
    "paired_uncertainty": with_views(f"""
WITH c AS (SELECT cell_id, CASE WHEN lucode = 1 THEN 0.0::DOUBLE ELSE size / 50 END AS habitat_suitability, light, CASE WHEN lucode = 2 THEN 0 ELSE 1 END AS feasible FROM cells),
d AS (SELECT season, cell_id, score AS m, round(habitat_suitability * (1.0::DOUBLE - light * (member + 1) / 3.0::DOUBLE), 9) AS h, feasible, habitat_suitability FROM members JOIN c USING (cell_id)),
e AS (SELECT *, {geometric_sql("m", "h", "0.5::DOUBLE")} AS cs, CASE WHEN feasible = 1 AND habitat_suitability > 0 THEN {geometric_sql("m", "(1.0::DOUBLE - h)", "0.5::DOUBLE")} ELSE 0.0::DOUBLE END AS rs, {ZONE_SQL} AS z FROM d),
g AS (SELECT season, cell_id, count(cs) AS n, quantile_cont(cs, [0.05, 0.5, 0.95]) AS cq, quantile_cont(rs, [0.05, 0.5, 0.95]) AS rq, median(m) AS m, median(h) AS h, max(feasible) AS feasible, max(habitat_suitability) AS habitat_suitability, list(z) AS zs FROM e GROUP BY ALL),
k AS (SELECT *, {ZONE_SQL} AS zz FROM g)
SELECT season, cell_id, {", ".join(f"CASE WHEN n = 3 THEN round({s}q[{i}], 6) + 0.0::DOUBLE END AS {name}_{p}" for s, name in (("c", "conservation"), ("r", "restoration")) for i, p in enumerate(("q05", "median", "q95"), 1))},
       CASE WHEN n = 3 THEN zz END AS zone, CASE WHEN n = 3 THEN round(len(list_filter(zs, lambda z: z = zz)) / 3.0::DOUBLE, 6) + 0.0::DOUBLE END AS zone_agreement FROM k""", "cells", "members"),
}
