"""python -m cellweave COMMAND: the library's entry points over files."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave import sinks
from cellweave.functions import scores
from cellweave.operators import models, parameters, provenance, ranking, selection, validate
from cellweave.sources import demo, files, rasters


def session() -> SparkSession:
    return SparkSession.builder.appName("cellweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _inputs() -> tuple:
    return tuple(F.col(c) for c in ("m", "h", "feasible", "habitat_suitability"))


def new_folder(path: str) -> Path:
    """The folder, made now; an error where it exists."""
    out = Path(path)
    out.mkdir(parents=True, exist_ok=False)
    return out


def scored(samples: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Samples with scores, eligibility and zone."""
    m, h, feasible, reference = _inputs()
    made = scores.fuse(m, h, feasible, reference, args.alpha, args.gamma, args.method, args.deficit_mode)
    return samples.withColumns(made | {"zone": scores.zone(m, h, feasible, reference, args.m_high, args.h_high)})


def baseline(spark: SparkSession, args: argparse.Namespace) -> dict:
    samples = files.read_samples(spark, args.csv)
    validate.require(validate.sample_violations(samples))
    out = new_folder(args.out)
    sinks.write_csv(scored(samples, args), str(out / "scores"))
    manifest = {"input": {"path": str(args.csv), "sha256": sinks.file_digest(args.csv)}, "method": args.method, "alpha": args.alpha, "gamma": args.gamma, "deficit_mode": args.deficit_mode}
    sinks.write_json(out / "manifest.json", manifest)
    return manifest


def gate_rows(samples: DataFrame) -> DataFrame:
    m, h, feasible, reference = _inputs()
    made = scores.features(m, h, F.col("u_m"), F.col("u_h"), F.col("season"))
    angles = {k: made[k].cast("double") for k in ("season_sin", "season_cos")}
    return samples.withColumns(angles | {"eligible": (feasible == 1) & (reference > 0)})


def audit(spark: SparkSession, samples: DataFrame, declared: dict, digest: str) -> dict:
    """Fail on a changed table, leaks, undeclared groups, or shared sites and groups; returns the counts."""
    if declared.get("table_sha256") != digest:
        raise validate.ValidationError("the table is not the one that was audited")
    rows = [(a, stage, kind, str(i)) for a, spec in declared["artifacts"].items() for stage in ("fit", "tune", "calibrate") for kind in ("sample", "group") for i in spec.get(f"{stage}_{kind}_ids", [])]
    footprints = spark.createDataFrame(rows, "artifact string, stage string, kind string, id string")
    artifacts = samples.select("sample_id", "group_id", F.explode(F.array("m_artifact_id", "h_artifact_id")).alias("artifact"))
    counts = {"leaks": provenance.leaks(artifacts, footprints).count()}
    found = provenance.footprint_consistency(samples, footprints)
    counts["inconsistent"] = found.where("n_unknown_samples > 0 OR n_groups_not_declared > 0").count()
    counts["shared"] = provenance.role_overlap(samples.where("role <> 'test'"), ["site_id", "group_id"]).where("n_shared > 0").count()
    unknown = artifacts.select("artifact").distinct().join(spark.createDataFrame([(a,) for a in declared["artifacts"]], "artifact string"), "artifact", "left_anti")
    counts["undeclared"] = unknown.count()
    bad = {k: v for k, v in counts.items() if v}
    if bad:
        raise validate.ValidationError(f"provenance: {bad}")
    return counts


def train(spark: SparkSession, args: argparse.Namespace) -> dict:
    samples = files.read_samples(spark, args.csv)
    validate.require(validate.sample_violations(samples, training=True))
    declared = files.read_json(args.provenance)
    if declared.get("data_kind") == "synthetic" and not args.demo:
        raise validate.ValidationError("synthetic data needs --demo")
    audit(spark, samples, declared, sinks.file_digest(args.csv))
    config = models.CONFIG | {"min_train_labels": 20, "min_val_labels": 5} | (files.read_json(args.config) if args.config else {})
    rows = gate_rows(samples)
    labels = rows.groupBy("role").agg(*(F.count(t).alias(t) for t in ("target_protection", "target_restoration"))).collect()
    enough = {t: all(r[t] >= (config["min_train_labels"] if r["role"] == "train" else config["min_val_labels"]) for r in labels if r["role"] != "test") for t in ("target_protection", "target_restoration")}
    if not any(enough.values()):
        raise validate.ValidationError("too few labels for either target")
    for t, fine in enough.items():
        if not fine:
            rows = rows.withColumn(t, F.lit(None).cast("double"))
    gate = models.train_gate(rows, config)
    out = new_folder(args.out)
    applied = models.apply_gate(rows, gate, ["sample_id"]).join(rows.select("sample_id", "role", "m", "h", "target_protection", "target_restoration"), "sample_id")
    sinks.write_csv(applied, str(out / "predictions"))
    fitted = {(t, k): models.constant_weight(rows.where("role = 'train'").withColumn("low", 1.0 - F.col("h")), t, "m", f, k, config["min_weight"]) for t, f in (("target_protection", "h"), ("target_restoration", "low")) for k in ("geometric", "linear")}
    report = {"epochs": len(gate.history), "enough_labels": enough, "controls": {f"{t}/{k}": v for (t, k), v in fitted.items()}, "metrics": evaluate(applied)}
    sinks.write_json(out / "gate.json", gate.dump() | {"synthetic": declared.get("data_kind") == "synthetic"})
    sinks.write_json(out / "history.json", gate.history)
    sinks.write_json(out / "report.json", report)
    return report


def evaluate(applied: DataFrame) -> list[dict]:
    """Errors and rank correlation of the gate by role and target."""
    parts = [applied.select("role", F.lit(t).alias("target"), F.col(t).alias("y"), F.col(p).alias("p")) for t, p in (("target_protection", "conservation"), ("target_restoration", "restoration"))]
    rows = parts[0].unionByName(parts[1]).where("y IS NOT NULL AND p IS NOT NULL")
    e = F.col("p") - F.col("y")
    found = rows.groupBy("role", "target").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    rank = ranking.spearman(rows, ["role", "target"], "y", "p").drop("n")
    return [r.asDict() for r in found.join(rank, ["role", "target"]).orderBy("target", "role").collect()]


def predict(spark: SparkSession, args: argparse.Namespace) -> dict:
    body = files.read_json(args.checkpoint)
    if body.get("synthetic") and not args.demo:
        raise validate.ValidationError("a gate from synthetic data needs --demo")
    samples = files.read_samples(spark, args.csv)
    validate.require(validate.sample_violations(samples))
    out = new_folder(args.out)
    sinks.write_csv(models.apply_gate(gate_rows(samples), models.DualGate.load(body), ["sample_id"]), str(out / "predictions"))
    manifest = {"checkpoint_sha256": sinks.file_digest(args.checkpoint), "input_sha256": sinks.file_digest(args.csv)}
    sinks.write_json(out / "manifest.json", manifest)
    return manifest


LAYERS = ("m", "h", "feasible", "habitat_suitability")

# Texts that the written layers carry.
SCORE_TEXTS = {"score_type": "dimensionless_research_index", "scientific_status": "unvalidated_on_real_observations"}
ZONE_TEXTS = {
    "zone_1": "protection_reference",
    "zone_2": "restoration_candidate_reference",
    "zone_3": "maintenance_reference",
    "zone_4": "general_management_reference",
    "zone_5": "requires_feasibility_or_conversion_scenario_review",
}


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """A raster as cells, by its suffix: GeoTIFF, or ASCII grid (plain or zipped)."""
    return rasters.read_rasters(spark, path) if path.lower().endswith((".tif", ".tiff")) else files.read_ascii_grids(spark, path)


def raster(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Fuse aligned rasters into a cell table with zone counts; GeoTIFF inputs give GeoTIFF layers as well."""
    joined: DataFrame | None = None
    for name in LAYERS:
        layer = read_grid(spark, getattr(args, name)).select("row", "col", F.col("x").alias(f"x_{name}"), F.col("y").alias(f"y_{name}"), F.col("value").alias(name))
        joined = layer if joined is None else joined.join(layer, ["row", "col"], "full_outer")
    apart = F.lit(False)
    for name in LAYERS[1:]:
        for axis in "xy":
            apart = apart | F.coalesce(F.abs(F.col(f"{axis}_m") - F.col(f"{axis}_{name}")) > 1e-9, F.lit(True))
    validate.require(validate.violations(joined, {"not_aligned": apart, **{f"{n}_outside_unit": validate.outside_unit(n, True) for n in LAYERS}}))
    out = new_folder(args.out)
    cells = scored(joined.select("row", "col", F.col("x_m").alias("x"), F.col("y_m").alias("y"), *LAYERS), args).withColumn("feasible", F.col("feasible").cast("int"))
    sinks.write_new(cells, str(out / "cells"))
    if str(args.m).lower().endswith((".tif", ".tiff")):
        grid, kept = rasters.raster_grid(str(args.m)), spark.read.parquet(str(out / "cells"))
        for name in ("conservation", "restoration"):
            rasters.write_raster(kept, grid, name, str(out / f"{name}.tif"), texts=SCORE_TEXTS)
        rasters.write_raster(kept, grid, "zone", str(out / "zone.tif"), "u1", 0, ZONE_TEXTS)
    counts = {str(r["zone"]): r["count"] for r in spark.read.parquet(str(out / "cells")).groupBy("zone").count().orderBy("zone").collect()}
    known = F.col("m").isNotNull() & F.col("h").isNotNull() & F.col("feasible").isNotNull() & F.col("habitat_suitability").isNotNull()
    differ = joined.select(F.count_if(~(known) & (F.coalesce("m", "h", "feasible", "habitat_suitability").isNotNull())).alias("n")).first()["n"]
    manifest = {"zones": counts, "valid_cells": sum(v for k, v in counts.items() if k != "0"), "mask_disagreement": differ, "inputs": {n: sinks.file_digest(getattr(args, n)) for n in LAYERS}}
    sinks.write_json(out / "manifest.json", manifest)
    return manifest


def invest_plan(spark: SparkSession, args: argparse.Namespace) -> dict:
    """One folder of parameter tables for each member of the ensemble; everything is checked first."""
    spec = files.read_json(args.prior)
    parameters.check_prior(spec)
    threats = files.read_csv(spark, args.threats, parameters.THREATS)
    sensitivity = files.read_all_text(spark, args.sensitivity)
    codes = read_grid(spark, args.lulc)
    plan = parameters.plan(spark, spec, threats, sensitivity, codes, args.members, args.seed)
    out = new_folder(args.out)
    for name, table in plan.items():
        sinks.write_new(table, str(out / name), "parquet", ["member_id"])
    manifest = {"members": args.members, "seed": args.seed, "inputs": {k: sinks.file_digest(getattr(args, k)) for k in ("prior", "threats", "sensitivity", "lulc")}, "status": "configurations only; nothing was run"}
    sinks.write_json(out / "manifest.json", manifest)
    return manifest


CALIBRATION = T.StructType([T.StructField("member_id", T.StringType()), T.StructField("fold", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("metric", T.StringType()), T.StructField("higher_is_better", T.IntegerType()), T.StructField("split_role", T.StringType())])


def calibration_rank(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = files.read_csv(spark, args.csv, CALIBRATION)
    validate.require_columns(rows, CALIBRATION.fieldNames())
    found = validate.violations(rows, {"not_inner_calibration": F.col("split_role") != "inner_calibration_validation", "score_not_finite": F.isnan("score") | (F.abs("score") == float("inf")), "direction_unknown": ~F.col("higher_is_better").isin(0, 1)})
    validate.require(found.unionByName(validate.repeated_keys(rows, "repeated_measurement", ["member_id", "fold"])))
    kinds = rows.agg(F.count_distinct("metric").alias("m"), F.count_distinct("higher_is_better").alias("d"), F.count_distinct("member_id").alias("n"), F.max("higher_is_better").alias("high"), F.max("metric").alias("metric")).first()
    if kinds["m"] != 1 or kinds["d"] != 1 or kinds["n"] < 2:
        raise validate.ValidationError("two or more members need one metric and one direction")
    ranked = selection.calibration_rank(rows, higher_is_better=bool(kinds["high"]))
    table = ranked.orderBy("rank").collect()  # one row for each member of the ensemble
    sinks.write_csv(ranked.orderBy("rank").coalesce(1), args.out)
    return {"status": "calibration candidates ranked; no evidence of final validity", "metric": kinds["metric"], "best_member": table[0]["member_id"], "candidates": len(table)}


def make_demo(spark: SparkSession, args: argparse.Namespace) -> dict:
    out = new_folder(args.out)
    return demo.write(out, args.seed)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellweave", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *required: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for r in required:
            p.add_argument(f"--{r}", required=True, dest=r.replace("-", "_"))
        return p

    def fusion(p: argparse.ArgumentParser) -> None:
        p.add_argument("--method", choices=["geometric", "linear", "minimum"], default="geometric")
        p.add_argument("--deficit-mode", choices=["low_hq", "relative_degradation"], default="low_hq")
        for name, value in (("--alpha", 0.5), ("--gamma", 0.5), ("--m-high", 0.7), ("--h-high", 0.7)):
            p.add_argument(name, type=float, default=value)

    fusion(command("baseline", baseline, "csv", "out"))
    fusion(command("raster", raster, "m", "h", "feasible", "habitat-suitability", "out"))
    p = command("train", train, "csv", "provenance", "out")
    p.add_argument("--config")
    p.add_argument("--demo", action="store_true")
    command("predict", predict, "csv", "checkpoint", "out").add_argument("--demo", action="store_true")
    command("demo", make_demo, "out").add_argument("--seed", type=int, default=42)
    p = command("invest-plan", invest_plan, "prior", "threats", "sensitivity", "lulc", "out")
    p.add_argument("--members", type=int, default=32)
    p.add_argument("--seed", type=int, default=42)
    command("invest-run", parameters.run_external, "args")
    command("calibration-rank", calibration_rank, "csv", "out")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    result = args.run(spark or session(), args)
    print(json.dumps(result, ensure_ascii=False, default=lambda v: v.item() if isinstance(v, np.generic) else str(v)))
    return result


if __name__ == "__main__":
    main(sys.argv[1:])
