"""Queries of habitat quality, grouped fits and cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.grid import to_degrees, to_utm, transverse_sql
from cellweave.operators import habitat, maxent, nested, ranking, selection, splits
from cellweave.plans.queries_scores import r6
from cellweave.plans.views import with_views
from cellweave.sinks import checkpointed
from cellweave.sources.bridge import Bridge

THREATS = [("urban", 300.0, 0.7, "linear"), ("light", 400.0, 0.3, "exponential")]
SEASONS = ["spring", "summer", "autumn", "winter"]
NAMES = ["size_scaled", "urban", "light"]


def _sensitivity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, c / 10.0, 1.0 - c / 20.0, c / 18.0) for c in range(1, 9)], "lucode int, habitat double, urban double, light double")


def _threat_cells(b: Bridge) -> DataFrame:
    """Cells of all layers; threats are capped at one."""
    return b.cells().select("cell_id", "row", "col", "lucode", F.least(F.lit(1.0), F.col("urban")).alias("urban"), "light")


def habitat_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = habitat.habitat_quality(_threat_cells(Bridge(spark, sf_dir)), THREATS, _sensitivity(spark), 0.2)
    return found.select((F.col("row") * 50 + F.col("col")).alias("cell_id"), r6(F.col("degradation"), "degradation"), r6(F.col("quality"), "quality"))


def _rows(b: Bridge) -> DataFrame:
    cells = b.cells().where("valid AND light IS NOT NULL").select("cell_id", (F.col("size") / 50.0).alias("size_scaled"), "urban", "light", "lucode")
    return b.background_b0().join(b.presence().withColumn("p", F.lit(1)), ["season", "cell_id"], "left").join(cells, "cell_id").withColumn("positive", F.col("p").isNotNull()).drop("p")


def derive_threat_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threat model of each season, presence against background."""
    found = nested.grouped_logistic(_rows(Bridge(spark, sf_dir)), ["season"], ["urban", "light"], "positive")
    return found.select("season", "term", F.round("coefficient", 6).alias("coefficient"), "n")


def derive_joint_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint model of each season: class indicators (code 1 is the reference) and threats."""
    rows = _rows(Bridge(spark, sf_dir)).select("*", *((F.col("lucode") == c).cast("double").alias(f"code_{c}") for c in range(2, 10)))
    found = nested.grouped_logistic(rows, ["season"], [f"code_{c}" for c in range(2, 10)] + ["urban", "light"], "positive")
    return found.select("season", "term", F.round("coefficient", 6).alias("coefficient"), "n")


def maxent_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum entropy of each season with linear, quadratic and hinge features; features without weight are left out."""
    found, _ = maxent.fit(_rows(Bridge(spark, sf_dir)), ["season"], NAMES, "positive", "LQH")
    return found.where("coefficient <> 0").select("season", "term", F.round("coefficient", 4).alias("coefficient"), "n_presence", F.round("entropy", 6).alias("entropy"))


def maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cloglog scores of the cells by season."""
    rows = checkpointed(_rows(Bridge(spark, sf_dir)))
    _, fits = maxent.fit(rows, ["season"], NAMES, "positive", "LQ")
    return maxent.project(rows, fits, ["season"], NAMES, "LQ").select("season", "cell_id", F.round("score", 5).alias("score"))


def _cross_validated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = Bridge(spark, sf_dir)
    cells = b.cells()
    folds, _ = splits.split_plan(cells, b.presence(), SEASONS)
    wide = cells.where("light IS NOT NULL").select("cell_id", (F.col("size") / 50.0).alias("size_scaled"), "urban", "light")
    return nested.cross_validate(wide, folds, b.presence(), NAMES)


def nested_cv_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cross_validated(spark, sf_dir)[0]
    return found.select("season", "outer", "n_fit", "n_validation", *(F.round(c, 6).alias(c) for c in ("fit_auc", "validation_auc", "auc_gap")))


def oof_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _cross_validated(spark, sf_dir)[1]
    return found.select("season", "cell_id", "fold", F.round("score", 6).alias("score"))


def _tuned(spark: SparkSession, sf_dir: str):
    b = Bridge(spark, sf_dir)
    cells = b.cells()
    folds, _ = splits.split_plan(cells, b.presence(), SEASONS)
    wide = cells.where("light IS NOT NULL").select("cell_id", (F.col("size") / 50.0).alias("size_scaled"), "urban", "light")
    metrics = checkpointed(nested.tune(wide, folds, b.presence(), NAMES))
    summary = selection.candidate_summary(metrics, ["season", "outer", "variant", "background", "rm", "fc"])
    return wide, folds, b.presence(), metrics, selection.choose(summary, ["season", "outer"], 0.4)


def nested_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of every candidate on every inner fold."""
    return _tuned(spark, sf_dir)[3].select("season", "outer", "inner_fold", "rm", "fc", *(F.round(c, 6).alias(c) for c in ("validation_auc", "omission_10", "auc_gap")), "complexity")


def nested_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of each outer fold by the one-standard-error rule."""
    return _tuned(spark, sf_dir)[4].select("season", "outer", "rm", "fc", F.round("mean_auc", 6).alias("mean_auc"), "omission_constraint_failed")


def nested_oof_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of the chosen candidates, summarised by season and fold."""
    wide, folds, presence, _, chosen = _tuned(spark, sf_dir)
    scores = checkpointed(nested.refit(wide, folds, presence, NAMES, chosen))
    shares = {"q05": 0.05, "median": 0.5, "q95": 0.95}
    found = ranking.match_left(scores.groupBy("season", "fold").agg(F.count("score").alias("n_cells")), ranking.group_quantiles(scores, ["season", "fold"], "score", shares), ["season", "fold"])
    return found.select("season", "fold", "n_cells", *(F.round(c, 6).alias(c) for c in shares))


def cell_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longitude and latitude of each cell's centre, and how far the way back misses it, in millimetres."""
    cells = Bridge(spark, sf_dir).cells()
    lon, lat = to_degrees(F.col("x"), F.col("y"))
    placed = cells.select("cell_id", "x", "y", lon.alias("longitude"), lat.alias("latitude"))
    e, n = to_utm(F.col("longitude"), F.col("latitude"))
    miss = F.round(F.greatest(F.abs(e - F.col("x")), F.abs(n - F.col("y"))) * 1000, 0).cast("long")
    return placed.select("cell_id", F.round("longitude", 8).alias("longitude"), F.round("latitude", 8).alias("latitude"), miss.alias("miss_mm"))


def replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the visit counts against another with planted changes."""
    one = Bridge(spark, sf_dir).visits()
    two = one.where("cell_id % 50 <> 3").withColumn("visits", F.when(F.col("cell_id") % 40 == 7, F.col("visits") + 1).otherwise(F.col("visits")))
    return nested.replay_differences(one, two, ["season", "cell_id"], ["visits"])


QUERIES = {f.__name__: f for f in (habitat_quality, derive_threat_fits, derive_joint_fits, nested_cv_metrics, oof_archive, nested_tuning, nested_choice, nested_oof_quantiles, cell_coordinates, replay_audit, maxent_fits, maxent_scores)}


def _offsets(name: str, far: float, weight: float, decay: str) -> str:
    return ", ".join(f"('{name}', {r}, {c}, {s!r}::DOUBLE)" for r, c, s in habitat.decay_offsets(far, decay, 100.0))


def _coordinates() -> str:
    k = transverse_sql()
    return f"""
WITH a AS (SELECT cell_id, x AS px, y AS py, y / {k["unit"]} AS xi, (x - {k["shift"]}) / {k["unit"]} AS eta FROM cells),
b AS (SELECT *, xi - ({k["x"]}) AS x, eta - ({k["e"]}) AS e FROM a),
c AS (SELECT *, asin(sin(x) / cosh(e)) AS chi FROM b),
d AS (SELECT cell_id, px, py, {k["meridian"]} + degrees(atan2(sinh(e), cos(x))) AS longitude, degrees(chi + {k["latitude"]}) AS latitude FROM c),
f AS (SELECT *, radians(latitude) AS phi, radians(longitude - {k["meridian"]}) AS lam FROM d),
g AS (SELECT *, sinh(atanh(sin(phi)) - {k["root"]} * atanh({k["root"]} * sin(phi))) AS t FROM f),
h AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM g),
i AS (SELECT *, {k["shift"]} + {k["unit"]} * (eta + {k["easting"]}) AS east, {k["unit"]} * (xi + {k["northing"]}) AS north FROM h)
SELECT cell_id, round(longitude, 8) AS longitude, round(latitude, 8) AS latitude, round(greatest(abs(east - px), abs(north - py)) * 1000, 0)::BIGINT AS miss_mm FROM i"""


ORACLE = {
    "cell_coordinates": with_views(_coordinates(), "cells"),
    "habitat_quality": with_views(f"""
WITH k AS (SELECT threat, dr, dc, s / sum(s) OVER (PARTITION BY threat) * CASE threat WHEN 'urban' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS s FROM (VALUES {", ".join(_offsets(*t) for t in THREATS)}) v(threat, dr, dc, s)),
t AS (SELECT "row", col, 'urban' AS threat, least(1.0::DOUBLE, urban) AS v FROM cells UNION ALL SELECT "row", col, 'light', light FROM cells),
d AS (SELECT "row" + dr AS "row", col + dc AS col, threat, sum(v * s) AS load FROM t JOIN k USING (threat) WHERE v > 0 GROUP BY ALL),
n AS (SELECT unnest(range(1, 9)) AS c),
j AS (SELECT cell_id, lucode, coalesce(sum(load * CASE threat WHEN 'urban' THEN 1.0::DOUBLE - c / 20.0::DOUBLE WHEN 'light' THEN c / 18.0::DOUBLE END), 0) AS degradation, any_value(c) AS c
      FROM cells LEFT JOIN d USING ("row", col) LEFT JOIN n ON c = lucode GROUP BY ALL)
SELECT cell_id, round(degradation, 6) + 0.0::DOUBLE AS degradation, round(c / 10.0::DOUBLE * (1.0::DOUBLE - pow(degradation, 2.5) / (pow(degradation, 2.5) + pow(0.2, 2.5))), 6) + 0.0::DOUBLE AS quality FROM j""", "cells"),
    "replay_audit": with_views("""
SELECT 'rows' AS "column", count(*) FILTER (WHERE cell_id % 50 = 3) AS n FROM visits UNION ALL SELECT 'visits', count(*) FILTER (WHERE cell_id % 50 <> 3 AND cell_id % 40 = 7) FROM visits""", "visits"),
}
