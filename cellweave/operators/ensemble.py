"""Ensemble summaries: exact quantiles over members, paired propagation, out-of-fold domain rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.scores import fuse, zone


def member_quantiles(members: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """q05, median, q95, population deviation and number of members of each cell."""
    q = F.percentile(score, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    found = members.groupBy(*keys).agg(q.alias("__q"), F.stddev_pop(score).alias("sd"), F.count(score).alias("member_count"))
    return found.select(*keys, F.col("__q")[0].alias("q05"), F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q95"), "sd", "member_count")


def paired_uncertainty(draws: DataFrame, keys: list[str], members: int, alpha: float = 0.5, gamma: float = 0.5) -> DataFrame:
    """Score quantiles and zone agreement over members that pair an m with an h.

    `draws` has (keys, member, m, h, feasible, habitat_suitability); a cell whose
    members are not all complete gets NULLs.  Agreement is the share of members
    whose zone is that of the members' medians.
    """
    m, h, f, r = (F.col(c) for c in ("m", "h", "feasible", "habitat_suitability"))
    scores = fuse(m, h, f, r, alpha, gamma)
    each = draws.withColumns({"__c": scores["conservation"], "__r": scores["restoration"], "__z": zone(m, h, f, r)})
    q = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    found = each.groupBy(*keys).agg(
        F.count(F.when(F.col("__c").isNotNull(), 1)).alias("__n"), F.percentile("__c", q).alias("__cq"), F.percentile("__r", q).alias("__rq"), F.percentile("m", 0.5).alias("__m"), F.percentile("h", 0.5).alias("__h"),
        F.max("feasible").alias("__f"), F.max("habitat_suitability").alias("__hs"), F.collect_list("__z").alias("__zs"),
    )
    whole = F.col("__n") == members
    centre = zone(F.col("__m"), F.col("__h"), F.col("__f"), F.col("__hs"))
    agree = F.size(F.filter("__zs", lambda z: z == centre)) / F.lit(float(members))
    columns = [F.when(whole, F.col(f"__{s}q")[i]).alias(f"{n}_{p}") for s, n in (("c", "conservation"), ("r", "restoration")) for i, p in enumerate(("q05", "median", "q95"))]
    return found.select(*keys, *columns, F.when(whole, centre).alias("zone"), F.when(whole, agree).alias("zone_agreement"))


def oof_violations(archive: DataFrame, folds: DataFrame, keys: list[str], members: int = 3) -> DataFrame:
    """Counts of broken rules of an out-of-fold archive against the validation cells of the folds."""
    left = archive.select(*(F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)), "q05", "median", "q95", "sd", "member_count", F.col("fold").alias("__fold_a"))
    right = folds.select(*(F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)), F.col("fold").alias("__fold_b"))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"__a{i}").eqNullSafe(F.col(f"__b{i}"))
    joined = left.withColumn("__in_a", F.lit(True)).join(right.withColumn("__in_b", F.lit(True)), on, "full_outer")
    inside, given = F.coalesce("__in_b", F.lit(False)), F.col("median").isNotNull()
    rules = {
        "missing_inside": inside & ~given,
        "present_outside": ~inside & given,
        "wrong_fold": inside & given & ~F.col("__fold_a").eqNullSafe(F.col("__fold_b")),
        "wrong_member_count": inside & given & (F.col("member_count") != members),
        "unordered_quantiles": given & ((F.col("q05") > F.col("median")) | (F.col("median") > F.col("q95"))),
        "negative_deviation": F.coalesce(F.col("sd") < 0, F.lit(False)),
    }
    counts = joined.agg(*(F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(n).alias("n_violations")) for n in rules))).alias("v")).select("v.*")
