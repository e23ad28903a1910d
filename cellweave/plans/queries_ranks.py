"""Queries of ranks, selection, pairs, ensembles and fits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import ensemble, models, ranking, runs, selection
from cellweave.plans.queries_scores import r6
from cellweave.plans.views import with_views
from cellweave.sinks import checkpointed, shared_dir
from cellweave.sources.bridge import PREDICTORS, Bridge

KEYS = ["season", "variant", "background", "rm", "fc"]


def auc_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.auc(Bridge(spark, sf_dir).scored(), ["season", "fold"], "positive", "score")
    return found.select("season", "fold", "n_presence", "n_background", r6(F.col("auc"), "auc"))


def omission_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranking.omission(Bridge(spark, sf_dir).scored(), ["season", "fold"], "positive", "score")
    return found.select("season", "fold", "n_presence", r6(F.col("threshold"), "threshold"), r6(F.col("omission"), "omission"))


def metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit (folds 0 and 1) and validation (fold 2) figures by season, with thresholds from the fit presences."""
    rows = Bridge(spark, sf_dir).scored().withColumn("part", F.when(F.col("fold") == 2, "validation").otherwise("fit"))
    auc = ranking.auc(rows, ["season", "part"], "positive", "score").groupBy("season").agg(F.max(F.when(F.col("part") == "fit", F.col("auc"))).alias("fit_auc"), F.max(F.when(F.col("part") == "validation", F.col("auc"))).alias("validation_auc"))
    counts = rows.groupBy("season", "part", "positive", "score").agg(F.count(F.lit(1)).alias("k"))
    presences = counts.where("part = 'fit' AND positive")
    fit = presences.groupBy("season").agg(F.min("score").alias("threshold_min")).join(ranking.group_quantiles(presences, ["season"], "score", {"threshold_10": 0.1}, "k"), "season")
    held = counts.where("part = 'validation' AND positive").join(fit, "season").groupBy("season", "threshold_10", "threshold_min").agg(
        (F.sum(F.when(F.col("score") < F.col("threshold_10"), F.col("k")).otherwise(0)) / F.sum("k")).alias("omission_10"), (F.sum(F.when(F.col("score") < F.col("threshold_min"), F.col("k")).otherwise(0)) / F.sum("k")).alias("omission_min")
    )
    spread = counts.groupBy("season").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    j = held.join(auc, "season").join(spread, "season")
    return j.select("season", r6(F.col("fit_auc"), "fit_auc"), r6(F.col("validation_auc"), "validation_auc"), r6(F.col("fit_auc") - F.col("validation_auc"), "auc_gap"), *(r6(F.col(c), c) for c in ("threshold_10", "threshold_min", "omission_10", "omission_min", "low", "high")))


def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of every two predictors over the valid cells."""
    cells = Bridge(spark, sf_dir).cells().where("valid")
    pairs = [(a, b) for i, a in enumerate(PREDICTORS) for b in PREDICTORS[i + 1 :]]
    long = cells.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs))).alias("p")).select("p.*")
    return ranking.spearman(long, ["a", "b"], "x", "y").select("a", "b", "n", r6(F.col("spearman"), "spearman"))


def threat_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Bridge(spark, sf_dir).cells().where("valid")
    rank = ranking.spearman(cells, [], "urban", "light").select("spearman")
    line = ranking.correlation(cells, [], "urban", "light").select("n", "pearson")
    return line.crossJoin(F.broadcast(rank)).select("n", r6(F.col("pearson"), "pearson"), r6(F.col("spearman"), "spearman"))


def predictor_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which predictors the alphabetical correlation screen keeps."""
    rows = spearman_pairs(spark, sf_dir).collect()  # one row for each pair of predictors
    matrix = {(r["a"], r["b"]): r["spearman"] for r in rows}
    constant = {n for n in PREDICTORS if all(v is None for k, v in matrix.items() if n in k)}
    kept = ranking.screen_by_correlation(list(PREDICTORS), matrix, constant)
    return spark.createDataFrame([(n, n in kept) for n in PREDICTORS], "predictor string, kept boolean")


def vif_corr_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["size", "price", "qty", "disc", "tax"]
    matrix, _ = models.correlation_matrix(Bridge(spark, sf_dir).cells().where("valid"), names)
    return spark.createDataFrame([(a, b, round(float(matrix[i, j]), 6) + 0.0) for i, a in enumerate(names) for j, b in enumerate(names) if i < j], "a string, b string, pearson double")


def vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variance inflation with an exact dependence among the predictors (NULL there)."""
    found = models.variance_inflation(Bridge(spark, sf_dir).cells().where("valid"), list(PREDICTORS))
    return spark.createDataFrame([(n, None if v is None else round(float(v), 6)) for n, v in found.items()], "predictor string, vif double")


def _two_members(b: Bridge) -> DataFrame:
    return b.members().groupBy("season", "cell_id").agg(F.max(F.when(F.col("member") == 0, F.col("score"))).alias("a"), F.max(F.when(F.col("member") == 1, F.col("score"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def topk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the top tenth of two members, ties cut in cell order."""
    rows = checkpointed(_two_members(Bridge(spark, sf_dir)))
    marked = ranking.top_share(ranking.top_share(rows, ["season"], "a", "cell_id", 0.1, "in_a"), ["season"], "b", "cell_id", 0.1, "in_b")
    both, one = F.count_if(F.col("in_a") & F.col("in_b")), F.count_if(F.col("in_a") | F.col("in_b"))
    return marked.groupBy("season").agg(F.count_if("in_a").alias("k"), both.alias("n_both"), r6(both / one, "jaccard"))


def topdecile_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the top tenth of two members by threshold, ties kept."""
    rows = _two_members(Bridge(spark, sf_dir))
    limits = ranking.group_quantiles(rows, ["season"], "a", {"ta": 0.9}).join(ranking.group_quantiles(rows, ["season"], "b", {"tb": 0.9}), "season")
    m = rows.join(limits, "season")
    a, b = F.col("a") >= F.col("ta"), F.col("b") >= F.col("tb")
    return m.groupBy("season").agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), r6(F.count_if(a & b) / F.count_if(a | b), "jaccard"))


def candidate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.candidate_summary(Bridge(spark, sf_dir).candidates(), KEYS)
    return found.select(*KEYS, "inner_folds", *(r6(F.col(c), c) for c in ("mean_auc", "auc_sd", "auc_se", "mean_omission", "mean_complexity", "mean_abs_auc_gap")))


def resumed_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate summary as a run of one scope for each season, begun by one ledger and taken up by another."""
    folds = Bridge(spark, sf_dir).candidates()
    folder = f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"
    make = {s: (lambda s=s: selection.candidate_summary(folds.where(F.col("season") == s), KEYS)) for s in ("spring", "summer", "autumn", "winter")}
    identity = {"inputs": runs.input_identity({"candidates": folds}), "keys": KEYS}
    runs.Ledger(spark, folder, identity).run({s: make[s] for s in ("spring", "winter")})
    found = runs.union_of(runs.Ledger(spark, folder, identity).run(make), "scope")
    return found.select("scope", *KEYS, "inner_folds", *(r6(F.col(c), c) for c in ("mean_auc", "auc_sd", "mean_omission", "mean_complexity")))


def _choice(within: list[str], limit: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        summary = selection.candidate_summary(Bridge(spark, sf_dir).candidates(), KEYS)
        found = selection.choose(summary, within, limit)
        return found.select(*KEYS, r6(F.col("mean_auc"), "mean_auc"), r6(F.col("mean_omission"), "mean_omission"), "omission_constraint_failed", r6(F.col("selection_auc_band_lower"), "selection_auc_band_lower"))

    return run


def constraint_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winners of each season and variant against their inner folds' convergence."""
    folds = Bridge(spark, sf_dir).candidates()
    winners = selection.choose(selection.candidate_summary(folds, KEYS), ["season", "variant"], 0.35)
    state = F.when(F.col("complexity") % 7 == 0, "hit_limit").when(F.col("complexity") % 7 == 1, "unknown").otherwise("converged")
    found = selection.constraint_audit(winners, folds.where("inner_fold <> 2 OR rm <> 4").withColumn("category", state), ["season", "variant"], KEYS, 0.35)
    return found.select(*KEYS, "inner_folds", "n_evidence", "n_hit_limit", "n_converged", "n_unknown", "omission_constraint_failed", "flag_consistent", "evidence_complete")


def calibration_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Bridge(spark, sf_dir).candidates().groupBy(F.concat_ws("/", "variant", "background", "fc").alias("member_id"), F.col("inner_fold").alias("fold")).agg(F.round(F.avg("validation_auc"), 12).alias("score"))
    found = selection.calibration_rank(rows)
    return found.select("member_id", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), "n_folds", r6(F.col("se"), "se"), "rank")


def paired_variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant v1 against v0 by season and inner fold on one background; only complete pairs."""
    rows = Bridge(spark, sf_dir).candidates().where("background = 'B1'").groupBy("season", "inner_fold", "variant").agg(F.avg("validation_auc").alias("auc"), F.avg("omission_10").alias("omission"))
    found = selection.paired(rows, ["season", "inner_fold"], "variant", "v0", "v1", ["auc", "omission"]).where("n_one = 1 AND n_two = 1")
    return found.select("season", "inner_fold", *(r6(F.col(c), c) for c in ("auc_one", "auc_two", "auc_difference", "omission_one", "omission_two", "omission_difference")))


def background_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Bridge(spark, sf_dir).candidates().groupBy("season", "variant", "background").agg(F.avg("validation_auc").alias("auc"))
    pairs = [("B0", "B1"), ("B0", "B2"), ("B1", "B2")]
    parts = [selection.paired(rows, ["season", "variant"], "background", a, b, ["auc"]).select("season", "variant", F.lit(f"{a}-{b}").alias("pair"), r6(F.col("auc_difference"), "auc_difference")) for a, b in pairs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Bridge(spark, sf_dir).candidates().groupBy("season", "variant", "inner_fold").agg(F.avg("validation_auc").alias("auc"), F.avg("omission_10").alias("omission"))
    found = selection.fold_metrics(rows, ["season", "variant"], ["auc", "omission"])
    return found.select("season", "variant", "n_folds", *(r6(F.col(c), c) for c in ("auc_mean", "auc_sd", "auc_var", "omission_mean", "omission_sd", "omission_var")))


def primary_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backgrounds that each variant's winners use by season, and whether the variants agree."""
    summary = selection.candidate_summary(Bridge(spark, sf_dir).candidates(), KEYS)
    won = selection.choose(summary, ["season", "variant"], 0.4)
    found = won.groupBy("season").agg(F.array_join(F.array_sort(F.collect_list("background")), ";").alias("backgrounds"), (F.count_distinct("background") == 1).alias("same_background"))
    return found


def _sets(b: Bridge) -> DataFrame:
    """A set of feature classes with good omission for each season and fold."""
    ok = b.candidates().where("omission_10 <= 0.4").groupBy("season", "inner_fold", F.concat_ws("/", "fc", "background").alias("member")).agg(F.count(F.lit(1)).alias("k")).where("k >= 4")
    return ok.groupBy("season", "inner_fold").agg(F.collect_set("member").alias("members"))


def predictor_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.jaccard_pairs(_sets(Bridge(spark, sf_dir)), ["season"], "inner_fold", "members")
    return found.select("season", "item_a", "item_b", r6(F.col("jaccard"), "jaccard"))


def predictor_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.frequency(_sets(Bridge(spark, sf_dir)), ["season"], "members")


def member_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ensemble.member_quantiles(Bridge(spark, sf_dir).members(), ["season", "cell_id"])
    return found.select("season", "cell_id", *(r6(F.col(c), c) for c in ("q05", "median", "q95", "sd")), "member_count")


def oof_domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of the complete members against folds by cell; planted faults are counted."""
    b = Bridge(spark, sf_dir)
    archive = ensemble.member_quantiles(b.members(), ["season", "cell_id"]).withColumn("fold", F.col("cell_id") % 3)
    folds = b.cells().where("valid").select("cell_id", (F.col("cell_id") % 3 + (F.col("cell_id") % 101 == 0).cast("int")).alias("fold")).crossJoin(spark.createDataFrame([(s,) for s in ("spring", "summer", "autumn", "winter")], "season string"))
    return ensemble.oof_violations(archive, folds, ["season", "cell_id"])


def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and rank correlation of a fixed control against the protection target by role."""
    from cellweave.functions.scores import geometric

    t = Bridge(spark, sf_dir).targets().select("role", F.col("target_protection").alias("y"), F.round(geometric(F.col("m"), F.col("h")), 9).alias("p")).where("y IS NOT NULL AND p IS NOT NULL")
    rank = ranking.spearman(t, ["role"], "y", "p").select("role", "spearman")
    e = F.col("p") - F.col("y")
    found = t.groupBy("role").agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(e * e)), "rmse"), r6(F.avg(F.abs(e)), "mae"))
    return found.join(rank, "role").select("role", "n", "rmse", "mae", r6(F.col("spearman"), "spearman"))


def logistic_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence against background over standardised layers, class-balanced."""
    b = Bridge(spark, sf_dir)
    cells = b.cells().where("valid AND qty IS NOT NULL").select("cell_id", (F.col("size") / 50.0).alias("size"), "urban", "light")
    rows = b.background_b0().join(b.presence().withColumn("y", F.lit(1)), ["season", "cell_id"], "left").join(cells, "cell_id").select("size", "urban", "light", F.coalesce("y", F.lit(0)).alias("y"))
    share = rows.agg(F.avg("y")).first()[0] or 0.5
    fit = models.ridge_logistic(rows.withColumn("w", F.when(F.col("y") == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9))), ["size", "urban", "light"], "y", "w")
    return spark.createDataFrame([(k, round(v, 4)) for k, v in fit.items()], "term string, coefficient double")


def class_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bridge(spark, sf_dir)
    rows = b.members().join(b.cells().select("cell_id", "lucode"), "cell_id")
    found = models.class_profile(rows, ["season"], "lucode", "score")
    return found.select("season", "lucode", r6(F.col("mean"), "mean"), r6(F.col("profile"), "profile"))


QUERIES = {f.__name__: f for f in (
    auc_by_fold, omission_by_fold, metric_bundle, spearman_pairs, threat_overlap, predictor_screen, vif_corr_matrix, vif, topk_overlap, topdecile_overlap, candidate_summary, resumed_scopes, calibration_rank, constraint_audit,
    paired_variant_metrics, background_pairs, fold_metrics, primary_scope, predictor_jaccard, predictor_frequency, member_quantiles, oof_domain_violations, regression_metrics, logistic_ridge, class_profile,
)} | {"candidate_choice": _choice(["season"], 0.4), "scheme_winners": _choice(["season", "variant", "background"], 0.35)}

_RANK = "(rank() OVER (PARTITION BY {g} ORDER BY {x}) + (count(*) OVER (PARTITION BY {g}, {x}) - 1) / 2.0::DOUBLE)"


def _spearman(rows: str, group: str, x: str, y: str) -> str:
    return f"""SELECT {group}, count(*) AS n, CASE WHEN count(*) > 2 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN round(corr(rx, ry), 6) + 0.0::DOUBLE END AS spearman
FROM (SELECT {group}, {_RANK.format(g=group, x=x)} AS rx, {_RANK.format(g=group, x=y)} AS ry FROM ({rows}) WHERE {x} IS NOT NULL AND {y} IS NOT NULL) GROUP BY {group}"""


_PRED = [(a, b) for i, a in enumerate(PREDICTORS) for b in PREDICTORS[i + 1 :]]
_PAIR_ROWS = " UNION ALL ".join(f"SELECT '{a}' || ',' || '{b}' AS g, {a} AS x, {b} AS y FROM cells WHERE valid" for a, b in _PRED)
_VIFS = [(a, b) for i, a in enumerate(["size", "price", "qty", "disc", "tax"]) for b in ["size", "price", "qty", "disc", "tax"][i + 1 :]]
_SUMMARY = """SELECT season, variant, background, rm, fc, count(DISTINCT inner_fold) AS inner_folds, round(avg(validation_auc), 12) AS mean_auc, round(stddev_samp(validation_auc), 12) AS auc_sd, round(stddev_samp(validation_auc) / sqrt(count(*)), 12) AS auc_se,
round(avg(omission_10), 12) AS mean_omission, round(avg(complexity), 12) AS mean_complexity, round(avg(abs(auc_gap)), 12) AS mean_abs_auc_gap FROM candidates GROUP BY ALL HAVING count(DISTINCT inner_fold) >= 2"""


def _choice_sql(within: str, limit: float) -> str:
    return f"""
s AS ({_SUMMARY}),
e AS (SELECT *, min(mean_omission) OVER w AS least, count(*) FILTER (WHERE mean_omission <= {limit}) OVER w = 0 AS omission_constraint_failed FROM s WINDOW w AS (PARTITION BY {within})),
k AS (SELECT * FROM e WHERE CASE WHEN omission_constraint_failed THEN mean_omission <= least + 1e-12 ELSE mean_omission <= {limit} END),
b AS (SELECT *, first_value(mean_auc) OVER w - first_value(coalesce(auc_se, 0)) OVER w AS selection_auc_band_lower FROM k WINDOW w AS (PARTITION BY {within} ORDER BY mean_auc DESC, coalesce(auc_se, 0))),
c AS (SELECT *, row_number() OVER (PARTITION BY {within} ORDER BY mean_complexity, mean_abs_auc_gap, rm DESC, length(fc), background, variant) AS place FROM b WHERE mean_auc >= selection_auc_band_lower - 1e-12)
SELECT season, variant, background, rm, fc, round(mean_auc, 6) + 0.0::DOUBLE AS mean_auc, round(mean_omission, 6) + 0.0::DOUBLE AS mean_omission, omission_constraint_failed, round(selection_auc_band_lower, 6) + 0.0::DOUBLE AS selection_auc_band_lower FROM c WHERE place = 1"""


_TWO = "t AS (SELECT season, cell_id, max(score) FILTER (WHERE member = 0) AS a, max(score) FILTER (WHERE member = 1) AS b FROM members GROUP BY ALL HAVING a IS NOT NULL AND b IS NOT NULL)"
_AUC = "(sum(r) FILTER (WHERE positive) - n_p * (n_p + 1) / 2.0::DOUBLE) / (n_p * n_b)"
_SETS = "x AS (SELECT season, inner_fold, fc || '/' || background AS member FROM candidates WHERE omission_10 <= 0.4 GROUP BY ALL HAVING count(*) >= 4), s AS (SELECT season, inner_fold, list(DISTINCT member) AS members FROM x GROUP BY ALL)"


def _aucs(groups: str, source: str) -> str:
    return f"""(SELECT {groups}, any_value(n_p) AS n_p, any_value(n_b) AS n_b, (sum(r) FILTER (WHERE positive) - any_value(n_p) * (any_value(n_p) + 1) / 2.0::DOUBLE) / nullif(any_value(n_p) * any_value(n_b), 0) AS auc
FROM (SELECT *, {_RANK.format(g=groups, x="score")} AS r, count(*) FILTER (WHERE positive) OVER (PARTITION BY {groups}) AS n_p, count(*) FILTER (WHERE NOT positive) OVER (PARTITION BY {groups}) AS n_b FROM {source}) GROUP BY {groups})"""


ORACLE = {
    "auc_by_fold": with_views(f"SELECT season, fold, n_p AS n_presence, n_b AS n_background, round(auc, 6) + 0.0::DOUBLE AS auc FROM {_aucs('season, fold', 'scored')}", "scored"),
    "omission_by_fold": with_views("""
SELECT season, fold, count(*) AS n_presence, round(any_value(t), 6) + 0.0::DOUBLE AS threshold, round(avg((score < t)::INT), 6) + 0.0::DOUBLE AS omission
FROM (SELECT * FROM scored WHERE positive) JOIN (SELECT season, fold, quantile_cont(score, 0.1) AS t FROM scored WHERE positive GROUP BY ALL) USING (season, fold) GROUP BY ALL""", "scored"),
    "metric_bundle": with_views(f"""
WITH p AS (SELECT *, CASE WHEN fold = 2 THEN 'validation' ELSE 'fit' END AS part FROM scored),
a AS (SELECT season, max(auc) FILTER (WHERE part = 'fit') AS fit_auc, max(auc) FILTER (WHERE part = 'validation') AS validation_auc FROM {_aucs("season, part", "p")} GROUP BY 1),
f AS (SELECT season, quantile_cont(score, 0.1) AS t10, min(score) AS t0 FROM p WHERE part = 'fit' AND positive GROUP BY 1),
v AS (SELECT season, avg((score < t10)::INT) AS o10, avg((score < t0)::INT) AS o0 FROM p JOIN f USING (season) WHERE part = 'validation' AND positive GROUP BY 1),
r AS (SELECT season, min(score) AS low, max(score) AS high FROM p GROUP BY 1)
SELECT season, {", ".join(f"round({x}, 6) + 0.0::DOUBLE AS {n}" for x, n in (("fit_auc", "fit_auc"), ("validation_auc", "validation_auc"), ("fit_auc - validation_auc", "auc_gap"), ("t10", "threshold_10"), ("t0", "threshold_min"), ("o10", "omission_10"), ("o0", "omission_min"), ("low", "low"), ("high", "high")))}
FROM a JOIN f USING (season) JOIN v USING (season) JOIN r USING (season)""", "scored"),
    "spearman_pairs": with_views(f"SELECT split_part(g, ',', 1) AS a, split_part(g, ',', 2) AS b, n, spearman FROM ({_spearman(_PAIR_ROWS, 'g', 'x', 'y')})", "cells"),
    "threat_overlap": with_views(f"SELECT n, (SELECT CASE WHEN min(urban) < max(urban) AND min(light) < max(light) THEN round(corr(urban, light), 6) + 0.0::DOUBLE END FROM cells WHERE valid AND urban IS NOT NULL AND light IS NOT NULL) AS pearson, spearman FROM ({_spearman('SELECT 1 AS g, urban, light FROM cells WHERE valid', 'g', 'urban', 'light')})", "cells"),
    "vif_corr_matrix": with_views(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) + 0.0::DOUBLE AS pearson FROM cells WHERE valid AND qty IS NOT NULL" for a, b in _VIFS), "cells"),
    "topk_overlap": with_views(f"""
WITH {_TWO},
r AS (SELECT *, row_number() OVER (PARTITION BY season ORDER BY a DESC, cell_id) AS ra, row_number() OVER (PARTITION BY season ORDER BY b DESC, cell_id) AS rb, greatest(1, ceil(count(*) OVER (PARTITION BY season) * 0.1::DOUBLE)) AS k FROM t)
SELECT season, count(*) FILTER (WHERE ra <= k) AS k, count(*) FILTER (WHERE ra <= k AND rb <= k) AS n_both, round(count(*) FILTER (WHERE ra <= k AND rb <= k) / count(*) FILTER (WHERE ra <= k OR rb <= k), 6) + 0.0::DOUBLE AS jaccard FROM r GROUP BY 1""", "members"),
    "topdecile_overlap": with_views(f"""
WITH {_TWO}, q AS (SELECT season, quantile_cont(a, 0.9) AS ta, quantile_cont(b, 0.9) AS tb FROM t GROUP BY 1)
SELECT season, count(*) FILTER (WHERE a >= ta) AS n_a, count(*) FILTER (WHERE b >= tb) AS n_b, round(count(*) FILTER (WHERE a >= ta AND b >= tb) / count(*) FILTER (WHERE a >= ta OR b >= tb), 6) + 0.0::DOUBLE AS jaccard FROM t JOIN q USING (season) GROUP BY 1""", "members"),
    "resumed_scopes": with_views(f"SELECT season AS scope, season, variant, background, rm, fc, inner_folds, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in ('mean_auc', 'auc_sd', 'mean_omission', 'mean_complexity'))} FROM ({_SUMMARY})", "candidates"),
    "candidate_summary": with_views(f"SELECT season, variant, background, rm, fc, inner_folds, {', '.join(f'round({c}, 6) + 0.0::DOUBLE AS {c}' for c in ('mean_auc', 'auc_sd', 'auc_se', 'mean_omission', 'mean_complexity', 'mean_abs_auc_gap'))} FROM ({_SUMMARY})", "candidates"),
    "constraint_audit": with_views("WITH won AS (WITH " + _choice_sql("season, variant", 0.35).strip() + """),
evidence AS (SELECT season, variant, background, rm, fc, count(*) AS n, count(*) FILTER (WHERE complexity % 7 = 0) AS h, count(*) FILTER (WHERE complexity % 7 = 1) AS u FROM candidates WHERE inner_fold <> 2 OR rm <> 4 GROUP BY ALL),
folds AS (SELECT season, variant, background, rm, fc, count(DISTINCT inner_fold) AS inner_folds, round(avg(omission_10), 12) AS omission FROM candidates GROUP BY ALL)
SELECT season, variant, background, rm, fc, inner_folds, coalesce(n, 0) AS n_evidence, coalesce(h, 0) AS n_hit_limit, coalesce(n - h - u, 0) AS n_converged, coalesce(u, 0) AS n_unknown, omission_constraint_failed,
       omission_constraint_failed = (omission > 0.35::DOUBLE) AS flag_consistent, coalesce(n, 0) = inner_folds AS evidence_complete
FROM won JOIN folds USING (season, variant, background, rm, fc) LEFT JOIN evidence USING (season, variant, background, rm, fc)""", "candidates"),
    "candidate_choice": with_views("WITH " + _choice_sql("season", 0.4).strip(), "candidates"),
    "scheme_winners": with_views("WITH " + _choice_sql("season, variant, background", 0.35).strip(), "candidates"),
    "calibration_rank": with_views("""
WITH f AS (SELECT variant || '/' || background || '/' || fc AS member_id, inner_fold AS fold, round(avg(validation_auc), 12) AS score FROM candidates GROUP BY ALL),
s AS (SELECT member_id, round(avg(score), 12) AS mean, stddev_samp(score) AS sd, count(*) AS n_folds FROM f GROUP BY 1)
SELECT member_id, round(mean, 6) + 0.0::DOUBLE AS mean, round(sd, 6) + 0.0::DOUBLE AS sd, n_folds, round(sd / sqrt(n_folds), 6) + 0.0::DOUBLE AS se, row_number() OVER (ORDER BY mean DESC, member_id)::INT AS rank FROM s""", "candidates"),
    "paired_variant_metrics": with_views("""
WITH f AS (SELECT season, inner_fold, variant, avg(validation_auc) AS auc, avg(omission_10) AS omission FROM candidates WHERE background = 'B1' GROUP BY ALL)
SELECT a.season, a.inner_fold, round(a.auc, 6) + 0.0::DOUBLE AS auc_one, round(b.auc, 6) + 0.0::DOUBLE AS auc_two, round(b.auc - a.auc, 6) + 0.0::DOUBLE AS auc_difference, round(a.omission, 6) + 0.0::DOUBLE AS omission_one, round(b.omission, 6) + 0.0::DOUBLE AS omission_two,
       round(b.omission - a.omission, 6) + 0.0::DOUBLE AS omission_difference FROM f a JOIN f b ON a.season = b.season AND a.inner_fold = b.inner_fold AND a.variant = 'v0' AND b.variant = 'v1'""", "candidates"),
    "background_pairs": with_views("""
WITH f AS (SELECT season, variant, background, avg(validation_auc) AS auc FROM candidates GROUP BY ALL)
SELECT a.season, a.variant, a.background || '-' || b.background AS pair, round(b.auc - a.auc, 6) + 0.0::DOUBLE AS auc_difference FROM f a JOIN f b ON a.season = b.season AND a.variant = b.variant AND a.background < b.background""", "candidates"),
    "fold_metrics": with_views("""
WITH f AS (SELECT season, variant, inner_fold, avg(validation_auc) AS auc, avg(omission_10) AS omission FROM candidates GROUP BY ALL)
SELECT season, variant, count(*) AS n_folds, round(avg(auc), 6) + 0.0::DOUBLE AS auc_mean, round(stddev_samp(auc), 6) + 0.0::DOUBLE AS auc_sd, round(var_samp(auc), 6) + 0.0::DOUBLE AS auc_var, round(avg(omission), 6) + 0.0::DOUBLE AS omission_mean,
       round(stddev_samp(omission), 6) + 0.0::DOUBLE AS omission_sd, round(var_samp(omission), 6) + 0.0::DOUBLE AS omission_var FROM f GROUP BY ALL""", "candidates"),
    "primary_scope": with_views("WITH " + _choice_sql("season, variant", 0.4).strip().replace("\nSELECT season, variant, background, rm, fc, round(mean_auc", ",\nw AS (SELECT season, variant, background FROM c WHERE place = 1)\nSELECT season, array_to_string(list_sort(list(background)), ';') AS backgrounds, count(DISTINCT background) = 1 AS same_background FROM w GROUP BY 1 -- "), "candidates"),
    "predictor_jaccard": with_views(f"WITH {_SETS} SELECT a.season, a.inner_fold AS item_a, b.inner_fold AS item_b, round(len(list_intersect(a.members, b.members)) / len(list_distinct(list_concat(a.members, b.members))), 6) + 0.0::DOUBLE AS jaccard FROM s a JOIN s b ON a.season = b.season AND a.inner_fold < b.inner_fold", "candidates"),
    "predictor_frequency": with_views(f"WITH {_SETS} SELECT season, member, count(*) AS n_sets FROM x GROUP BY ALL", "candidates"),
    "member_quantiles": with_views("""
SELECT season, cell_id, round(q[1], 6) + 0.0::DOUBLE AS q05, round(q[2], 6) + 0.0::DOUBLE AS median, round(q[3], 6) + 0.0::DOUBLE AS q95, round(sd, 6) + 0.0::DOUBLE AS sd, member_count
FROM (SELECT season, cell_id, quantile_cont(score, [0.05, 0.5, 0.95]) AS q, stddev_pop(score) AS sd, count(score) AS member_count FROM members GROUP BY ALL)""", "members"),
    "oof_domain_violations": with_views("""
WITH a AS (SELECT season, cell_id, quantile_cont(score, [0.05, 0.5, 0.95]) AS q, stddev_pop(score) AS sd, count(score) AS n, cell_id % 3 AS fold FROM members GROUP BY ALL),
f AS (SELECT cell_id, season, cell_id % 3 + (cell_id % 101 = 0)::INT AS fold FROM cells, (SELECT unnest(['spring', 'summer', 'autumn', 'winter']) AS season) WHERE valid),
j AS (SELECT q, sd, n, a.fold AS fa, f.fold AS fb FROM a FULL JOIN f USING (season, cell_id))
SELECT 'missing_inside' AS rule, count(*) FILTER (WHERE fb IS NOT NULL AND q IS NULL) AS n_violations FROM j UNION ALL SELECT 'present_outside', count(*) FILTER (WHERE fb IS NULL AND q IS NOT NULL) FROM j
UNION ALL SELECT 'wrong_fold', count(*) FILTER (WHERE fb IS NOT NULL AND q IS NOT NULL AND fa IS DISTINCT FROM fb) FROM j UNION ALL SELECT 'wrong_member_count', count(*) FILTER (WHERE fb IS NOT NULL AND q IS NOT NULL AND n <> 3) FROM j
UNION ALL SELECT 'unordered_quantiles', count(*) FILTER (WHERE q[1] > q[2] OR q[2] > q[3]) FROM j UNION ALL SELECT 'negative_deviation', count(*) FILTER (WHERE sd < 0) FROM j""", "cells", "members"),
    "regression_metrics": with_views(f"""
WITH p AS (SELECT role, target_protection AS y, round(exp(0.5::DOUBLE * ln(greatest(m, 1e-8::DOUBLE)) + 0.5::DOUBLE * ln(greatest(h, 1e-8::DOUBLE))) * CASE WHEN m = 0 OR h = 0 THEN 0 ELSE 1 END, 9) AS p FROM targets WHERE target_protection IS NOT NULL AND m IS NOT NULL),
s AS ({_spearman("SELECT * FROM p", "role", "y", "p")})
SELECT role, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) + 0.0::DOUBLE AS rmse, round(avg(abs(p - y)), 6) + 0.0::DOUBLE AS mae, any_value(spearman) AS spearman FROM p JOIN s USING (role) GROUP BY role""", "targets"),
    "class_profile": with_views("SELECT season, lucode, round(m, 6) + 0.0::DOUBLE AS mean, round(m / max(m) OVER (PARTITION BY season), 6) + 0.0::DOUBLE AS profile FROM (SELECT season, lucode, avg(score) AS m FROM members JOIN cells USING (cell_id) GROUP BY ALL)", "members", "cells"),
}
