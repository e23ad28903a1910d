"""Ranks, rank statistics and top shares without a global sort in one task.

Values are first counted (rows with equal values become one row), then dealt to
ordered buckets whose bounds come from approximate quantiles, and summed in two
levels: over buckets, and inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.sinks import checkpointed

#: Distinct rows that a bucket is to hold, about, and the most bounds that one expression compares.
BUCKET_ROWS = 1_000_000
MOST_BOUNDS = 4_096


def below(counts: DataFrame, groups: list[str], order: str, sums: list[str]) -> DataFrame:
    """For rows that are distinct in (groups, order): `<sum>_below`, the total of each sum column before the row.

    The bounds only divide the work; they don't affect the result.  Buckets
    grow in number with the distinct rows; those are counted once.
    """
    counts = checkpointed(counts)
    buckets = max(8, min(MOST_BOUNDS, -(-counts.count() // BUCKET_ROWS)))
    quantiles = [k / buckets for k in range(1, buckets)]
    bounds = counts.agg(F.percentile_approx(order, quantiles, 20 * buckets)).first()[0] or []
    bounds = sorted(set(bounds))
    if bounds:
        bucket = _bucket(F.col(order), bounds)
    else:
        bucket = F.lit(0)
    dealt = counts.withColumn("__bucket", bucket)
    totals = dealt.groupBy(*groups, "__bucket").agg(*(F.sum(s).alias(f"__{s}_all") for s in sums))
    outer = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*groups, "__bucket", *(F.coalesce(F.sum(f"__{s}_all").over(outer), F.lit(0)).alias(f"__{s}_start") for s in sums))
    joined = match(dealt, starts, [*groups, "__bucket"])
    inner = Window.partitionBy(*groups, "__bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = joined.withColumns({f"{s}_below": F.col(f"__{s}_start") + F.coalesce(F.sum(s).over(inner), F.lit(0)) for s in sums})
    return found.drop("__bucket", *(f"__{s}_start" for s in sums))


def _bucket(value: Column, bounds: list) -> Column:
    """How many of the ascending bounds are at most the value; in two steps, so that a row meets few of them."""
    step = max(1, round(len(bounds) ** 0.5))

    def passed(held: Column) -> Column:
        return F.size(F.filter(held, lambda b: b <= value))

    begin = F.greatest(passed(F.array(*(F.lit(b) for b in bounds[::step]))) - 1, F.lit(0)) * step
    return begin + passed(F.slice(F.array(*(F.lit(b) for b in bounds)), begin + 1, F.lit(step)))


def match(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL; the right side's keys are dropped."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row: totals without groups
    renamed = right.withColumnsRenamed({k: f"__right_{i}" for i, k in enumerate(keys)})
    return left.join(renamed, _all([F.col(k).eqNullSafe(F.col(f"__right_{i}")) for i, k in enumerate(keys)])).drop(*(f"__right_{i}" for i in range(len(keys))))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def average_ranks(rows: DataFrame, groups: list[str], value: str, name: str, weight: str | None = None) -> DataFrame:
    """(groups, value, name): each distinct value's rank, ties at their average; a row may stand for `weight` rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n"))
    ranked = below(counts, groups, value, ["__n"])
    return ranked.select(*groups, value, (F.col("__n_below") + (F.col("__n") + 1) / 2.0).alias(name))


def auc(scored: DataFrame, groups: list[str], positive: str, score: str) -> DataFrame:
    """(groups, n_presence, n_background, auc): Mann-Whitney statistic, ties half credit; NULL without both classes."""
    flag = F.col(positive).cast("long")
    counts = scored.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.sum(flag).alias("__p"), F.sum(1 - flag).alias("__b"))
    return auc_of_counts(counts, groups, score, "__p", "__b")


def auc_of_counts(counts: DataFrame, groups: list[str], score: str, presences: str, background: str) -> DataFrame:
    """As `auc`, for the numbers of both classes at each score, which is distinct within its group."""
    counts = counts.select(*groups, score, F.col(presences).alias("__p"), F.col(background).alias("__b"))
    ranked = below(counts, groups, score, ["__b"])
    won = F.sum(F.col("__p") * (F.col("__b_below") + F.col("__b") / 2.0))
    totals = ranked.groupBy(*groups).agg(F.sum("__p").alias("n_presence"), F.sum("__b").alias("n_background"), won.alias("__won"))
    return totals.select(*groups, "n_presence", "n_background", F.try_divide("__won", (F.col("n_presence") * F.col("n_background")).cast("double")).alias("auc"))


def correlation(rows: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(groups, n, pearson): NULL where either side is constant or fewer than three pairs exist."""
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    summed = pairs.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop(a, b).alias("__c"), F.stddev_pop(a).alias("__a"), F.stddev_pop(b).alias("__b"), (F.min(a) < F.max(a)).alias("__va"), (F.min(b) < F.max(b)).alias("__vb")
    )
    fine = F.col("__va") & F.col("__vb") & (F.col("n") > 2)
    return summed.select(*groups, "n", F.when(fine, F.try_divide("__c", F.col("__a") * F.col("__b"))).alias("pearson"))


def spearman(rows: DataFrame, groups: list[str], a: str, b: str) -> DataFrame:
    """(groups, n, spearman) over pairwise complete rows, with average tied ranks.

    Pairs are counted into a checkpoint that both ranks are taken from: a value
    computed anew (a mean whose order of summation changes) would miss its rank.
    """
    pairs = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, F.col(a).alias("__x"), F.col(b).alias("__y"))
    cells = checkpointed(pairs.groupBy(*groups, "__x", "__y").agg(F.count(F.lit(1)).alias("__k")))
    rx, ry = average_ranks(cells, groups, "__x", "__rx", "__k"), average_ranks(cells, groups, "__y", "__ry", "__k")
    joined = cells
    for ranks, key in ((rx, "__x"), (ry, "__y")):
        joined = match(joined, ranks, [*groups, key])
    k = F.col("__k").cast("double")
    summed = joined.groupBy(*groups).agg(
        F.sum("__k").alias("n"), F.sum(k * F.col("__rx")).alias("sx"), F.sum(k * F.col("__ry")).alias("sy"), F.sum(k * F.col("__rx") * F.col("__rx")).alias("sxx"),
        F.sum(k * F.col("__ry") * F.col("__ry")).alias("syy"), F.sum(k * F.col("__rx") * F.col("__ry")).alias("sxy"),
    )
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    rho = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(vx) * F.sqrt(vy))
    return summed.select(*groups, "n", F.when((n > 2) & (vx > 0) & (vy > 0), rho).alias("spearman"))


def group_quantiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """(groups, a column for each named share): exact linear quantiles of the values that are not null.

    Selection by counting: values are counted, totals below each value come from
    `below`, and the two values around the wanted place are picked by an
    aggregation, so no group's values are held together.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("__v")).agg(n.alias("__n"))
    ranked = below(counts, groups, "__v", ["__n"])
    totals = ranked.groupBy(*groups).agg(F.sum("__n").alias("__total"))
    placed = match(ranked.select(*groups, "__v", "__n", "__n_below"), totals, groups)
    picks = []
    for name, share in shares.items():
        at = (F.col("__total") - 1) * F.lit(float(share))
        for side, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            here = (F.col("__n_below") <= place) & (place < F.col("__n_below") + F.col("__n"))
            picks.append(F.max(F.when(here, F.col("__v"))).alias(f"__{name}_{side}"))
    held = placed.groupBy(*groups, "__total").agg(*picks)

    def between(name: str, share: float) -> Column:
        at = (F.col("__total") - 1) * F.lit(float(share))
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        return F.when(low == high, low.cast("double")).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return held.select(*groups, *(between(name, share).alias(name) for name, share in shares.items()))


def omission(scored: DataFrame, groups: list[str], positive: str, score: str, share: float = 0.1) -> DataFrame:
    """(groups, threshold, omission): presences strictly below the `share` quantile of the presences' scores.

    The quantile is the linear one over the counted values, exact at any size.
    """
    counts = scored.where(F.col(positive) & F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count(F.lit(1)).alias("__k"))
    joined = match(counts, group_quantiles(counts, groups, score, {"threshold": share}, "__k"), groups)
    n = F.sum("__k")
    return joined.groupBy(*groups, "threshold").agg((F.sum(F.when(F.col(score) < F.col("threshold"), F.col("__k")).otherwise(0)) / n).alias("omission"), n.alias("n_presence"))


def top_share(rows: DataFrame, groups: list[str], score: str, tiebreak: str, share: float, name: str) -> DataFrame:
    """Rows with a boolean `name`: among the ceil(share * n) highest (at least one), ties cut by the tiebreak.

    Rows without a score are not counted and never inside.  The tiebreak is a
    number that differs within a group.  A group's cut is one
    score; only rows with that score are ranked by the tiebreak, by counting
    again, so a score that half of the rows share is sorted in no single task.
    The rows are read three times, from a checkpoint: scores must be the same each time.
    """
    rows = checkpointed(rows)
    counts = rows.where(F.col(score).isNotNull()).groupBy(*groups, score).agg(F.count(F.lit(1)).alias("__n")).withColumn("__down", -F.col(score))
    ranked = below(counts, groups, "__down", ["__n"])
    totals = counts.groupBy(*groups).agg(F.greatest(F.lit(1), F.ceil(F.sum("__n") * share)).alias("__k"))
    at_cut = (F.col("__n_below") < F.col("__k")) & (F.col("__n_below") + F.col("__n") >= F.col("__k"))
    cuts = match(ranked.select(*groups, F.col(score).alias("__cut"), "__n", "__n_below"), totals, groups).where(at_cut)
    cuts = checkpointed(cuts.select(*groups, "__cut", (F.col("__k") - F.col("__n_below")).alias("__room"), "__n"))
    known = match(rows, cuts, groups)
    tied = known.where((F.col(score) == F.col("__cut")) & (F.col("__room") < F.col("__n"))).groupBy(*groups, tiebreak).agg(F.count(F.lit(1)).alias("__m"))
    # The last tiebreak that is still inside, for each group whose cut splits a score.
    places = match(below(tied, groups, tiebreak, ["__m"]), cuts, groups)
    last = places.where(F.col("__m_below") < F.col("__room")).groupBy(*groups).agg(F.max(tiebreak).alias("__last"))
    limits = match_left(cuts, last, groups)
    inside = (F.col(score) > F.col("__cut")) | ((F.col(score) == F.col("__cut")) & (F.col("__last").isNull() | (F.col(tiebreak) <= F.col("__last"))))
    return match(rows, limits, groups).withColumn(name, F.coalesce(inside, F.lit(False))).select(*rows.columns, name)


def match_left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """As `match`, keeping left rows without a partner."""
    renamed = right.withColumnsRenamed({k: f"__right_{i}" for i, k in enumerate(keys)})
    same = _all([F.col(k).eqNullSafe(F.col(f"__right_{i}")) for i, k in enumerate(keys)]) if keys else F.lit(True)
    return left.join(renamed, same, "left").drop(*(f"__right_{i}" for i in range(len(keys))))


def screen_by_correlation(names: list[str], pairs: dict[tuple[str, str], float | None], constant: set[str], cutoff: float = 0.7) -> list[str]:
    """Predictors in alphabetical order that are not constant and stay below the cutoff with all kept before."""
    kept: list[str] = []
    for name in sorted(names):
        if name in constant:
            continue
        if all(abs(pairs.get((k, name), pairs.get((name, k))) or 0.0) < cutoff for k in kept):
            kept.append(name)
    if not kept:
        raise ValueError("no predictor is left")
    return kept
