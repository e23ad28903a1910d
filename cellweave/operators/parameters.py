"""Parameter ensembles: prior rules, sampled overrides, per-member tables and their checks."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.keys import blank
from cellweave.operators import validate
from cellweave.operators.sampling import latin_hypercube

THREATS = T.StructType([
    T.StructField("threat", T.StringType()), T.StructField("max_dist", T.DoubleType()), T.StructField("weight", T.DoubleType()), T.StructField("decay", T.StringType()),
    T.StructField("cur_path", T.StringType()), T.StructField("base_path", T.StringType()), T.StructField("fut_path", T.StringType()),
])
#: Kinds of parameter keys and how many parts follow the kind.
KINDS = {"weight": 1, "distance": 1, "habitat": 1, "sensitivity": 2, "half_saturation_constant": 0}


def check_prior(spec: dict) -> None:
    """Fail unless every parameter has a known key, ordered finite bounds and evidence, once each."""
    if spec.get("distance_unit") not in ("m", "metre", "meters", "metres"):
        raise validate.ValidationError("distances must be declared in metres")
    seen = set()
    for p in spec.get("parameters", []):
        kind, *rest = p["key"].split(":")
        if kind not in KINDS or len(rest) != KINDS[kind] or not all(rest):
            raise validate.ValidationError(f"unknown parameter key {p['key']!r}")
        if p["key"] in seen:
            raise validate.ValidationError(f"parameter key {p['key']!r} is repeated")
        seen.add(p["key"])
        low, high = float(p["low"]), float(p["high"])
        unit = kind in ("weight", "habitat", "sensitivity")
        if not (math.isfinite(low) and math.isfinite(high) and low < high) or (unit and not 0 <= low < high <= 1) or (not unit and low <= 0):
            raise validate.ValidationError(f"bounds of {p['key']!r} are out of order or range")
        if not str(p.get("evidence", "")).strip():
            raise validate.ValidationError(f"{p['key']!r} has no evidence")
    if not seen:
        raise validate.ValidationError("the prior has no parameters")


def sample_prior(spark: SparkSession, spec: dict, members: int, seed: int) -> DataFrame:
    """(member_id, key, value) by Latin hypercube over the bounds."""
    return latin_hypercube(spark, {p["key"]: (float(p["low"]), float(p["high"])) for p in spec["parameters"]}, members, seed)


def override(base: DataFrame, samples: DataFrame, kind: str, key: str, column: str) -> DataFrame:
    """Each member's copy of a base table with one column replaced where a sample names its key."""
    members = samples.select("member_id").distinct()
    mine = samples.where(F.split("key", ":")[0] == kind).select("member_id", F.split("key", ":")[1].alias("__key"), F.col("value").alias("__value"))
    rows = base if "member_id" in base.columns else members.crossJoin(base)
    joined = rows.join(mine.withColumnRenamed("member_id", "__member"), (F.col("member_id") == F.col("__member")) & (F.col(key).cast("string") == F.col("__key")), "left")
    return joined.withColumn(column, F.coalesce("__value", F.col(column))).drop("__member", "__key", "__value")


def plan(spark: SparkSession, spec: dict, threats: DataFrame, sensitivity: DataFrame, codes: DataFrame, members: int, seed: int, pixel: float = 100.0) -> dict[str, DataFrame]:
    """The ensemble's threat, sensitivity and half-saturation tables by member, after all rules hold."""
    validate.require_columns(threats, ["threat", "max_dist", "weight", "decay", "cur_path"])
    validate.require_columns(sensitivity, ["lucode", "habitat"])
    samples = sample_prior(spark, spec, members, seed)
    names = [r["threat"] for r in threats.select("threat").collect()]  # a run's handful of threats
    validate.require_columns(sensitivity, names)
    pieces = F.split("key", ":")
    known = F.when(pieces[0].isin("weight", "distance"), pieces[1].isin(*names)).when(pieces[0] == "sensitivity", pieces[2].isin(*names)).otherwise(True)
    rules = validate.violations(samples, {"unknown_target": ~known})
    rules = rules.unionByName(validate.repeated_keys(threats, "repeated_threat", ["threat"])).unionByName(validate.repeated_keys(sensitivity, "repeated_code", ["lucode"]))
    rules = rules.unionByName(validate.violations(threats, {"blank_threat": blank(F.col("threat")), "no_current_path": blank(F.col("cur_path"))}))
    whole = codes.where("value IS NOT NULL").select(F.col("value").cast("int").cast("string").alias("lucode"), (F.col("value") != F.floor("value")).alias("part"))
    rules = rules.unionByName(validate.violations(whole, {"fractional_code": F.col("part")}))
    missing = whole.select("lucode").distinct().join(sensitivity.select("lucode"), "lucode", "left_anti").agg(F.lit("code_without_sensitivity").alias("rule"), F.count(F.lit(1)).alias("n_violations"))
    validate.require(rules.unionByName(missing))
    own = override(override(threats, samples, "weight", "threat", "weight"), samples, "distance", "threat", "max_dist")
    validate.require(validate.parameter_violations(own, pixel))
    numeric = sensitivity.select("lucode", *(F.col(c).cast("double").alias(c) for c in ("habitat", *names)))
    table = override(numeric, samples, "habitat", "lucode", "habitat")
    for n in names:
        mine = samples.where(F.col("key").startswith("sensitivity:") & F.col("key").endswith(f":{n}"))
        table = override(table, mine.unionByName(samples.where("false")), "sensitivity", "lucode", n) if not mine.isEmpty() else table
    validate.require(validate.violations(table, {f"{c}_outside_unit": validate.outside_unit(c) for c in ("habitat", *names)}))
    fixed = spec.get("fixed_half_saturation_constant")
    half = samples.groupBy("member_id").agg(F.coalesce(F.max(F.when(F.col("key") == "half_saturation_constant", F.col("value"))), F.lit(fixed).cast("double")).alias("half_saturation_constant"))
    validate.require(validate.violations(half, {"half_saturation_not_positive": ~F.coalesce(F.col("half_saturation_constant") > 0, F.lit(False))}))
    return {"threats": own, "sensitivity": table, "half_saturation": half}


def run_external(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Hand a member's arguments to the external habitat model where it is installed."""
    try:
        from natcap.invest import habitat_quality
    except ImportError as error:
        raise RuntimeError("the external habitat model is not installed; the plan's tables are ready for it") from error
    from cellweave.sources.files import read_json

    habitat_quality.execute(read_json(args.args))
    return {"status": "done"}
