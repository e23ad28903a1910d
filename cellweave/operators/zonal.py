"""Statistics by class, layer inventories, confusion tables, scenario designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from cellweave.functions.scores import detection
from cellweave.operators import ranking


def zonal_stats(cells: DataFrame, by: list[str], layers: list[str]) -> DataFrame:
    """Cells, mean and exact median of each layer by class."""
    means = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n_cells"), *(F.avg(c).alias(f"{c}_mean") for c in layers))
    long = cells.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("layer"), F.col(c).cast("double").alias("value")) for c in layers))).alias("__at")).select(*by, "__at.layer", "__at.value")
    medians = ranking.group_quantiles(long, [*by, "layer"], "value", {"median": 0.5})
    wide = medians.groupBy(*by).agg(*(F.max(F.when(F.col("layer") == c, F.col("median"))).alias(f"{c}_median") for c in layers))
    return ranking.match_left(means, wide, by).select(*by, "n_cells", *(f"{c}_{k}" for c in layers for k in ("mean", "median")))


def coverage(cells: DataFrame, name: str, support: str, common: str, development: str) -> DataFrame:
    """One panel row: support crossed with the common and development domains."""
    s, c, d = (F.coalesce(F.col(x), F.lit(False)) for x in (support, common, development))
    return cells.agg(
        F.lit(name).alias("name"), F.count_if(s).alias("n_support"), F.count_if(s & c).alias("n_support_common"), F.count_if(~s & c).alias("n_missing_common"),
        F.count_if(s & d).alias("n_support_development"), F.count_if(~s & d).alias("n_missing_development"),
    )


def class_density(cells: DataFrame, occupied: DataFrame, by: str, cell_km2: float = 0.01) -> DataFrame:
    """Occupied cells of each class over all seasons, per 1000 square kilometres of the class."""
    marks = occupied.select("cell_id").distinct().withColumn("__hit", F.lit(1))
    found = cells.join(marks, "cell_id", "left").groupBy(by).agg(F.count(F.lit(1)).alias("n_cells"), F.count("__hit").alias("n_occupied"))
    return found.withColumn("per_1000_km2", F.try_divide(F.col("n_occupied") * 1000.0, F.col("n_cells") * F.lit(cell_km2)))


def layer_inventory(cells: DataFrame, layers: list[str]) -> DataFrame:
    """(layer, n_valid, n_missing, low, high, mean, is_constant) in one pass."""
    rows = [
        F.struct(F.lit(c).alias("layer"), F.count(c).alias("n_valid"), (F.count(F.lit(1)) - F.count(c)).alias("n_missing"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.coalesce(F.max(c) - F.min(c) <= 1e-12, F.lit(True)).alias("is_constant"))
        for c in layers
    ]
    return cells.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def confusion(cells: DataFrame, label: str, components: list[str]) -> DataFrame:
    """(label, predicted, n, n_ties): label against the first largest component (1-based)."""
    values = F.array(*components)
    top = F.array_max(values)
    marked = cells.select(label, F.array_position(values, top).cast("int").alias("predicted"), (F.size(F.filter(values, lambda v: v == top)) > 1).alias("tie"))
    return marked.groupBy(label, "predicted").agg(F.count(F.lit(1)).alias("n"), F.count_if("tie").alias("n_ties"))


def presence_ratio(rows: DataFrame, by: list[str], positive: str) -> DataFrame:
    """Presences, background and their ratio by class."""
    found = rows.groupBy(*by).agg(F.count_if(positive).alias("n_presence"), F.count_if(~F.col(positive)).alias("n_background"))
    return found.withColumn("ratio", F.try_divide(F.col("n_presence").cast("double"), F.col("n_background")))


def class_estimability(rows: DataFrame, by: list[str], klass: str, positive: str, least: int) -> DataFrame:
    """By class: presences, background, the smoothed log-odds of presence, and whether both sides have `least` rows."""
    found = rows.groupBy(*by, klass).agg(F.count_if(positive).alias("n_presence"), F.count_if(~F.col(positive)).alias("n_background"))
    p, b = F.col("n_presence"), F.col("n_background")
    return found.withColumns({"estimable": (p >= least) & (b >= least), "log_odds": F.log((p + 0.5) / (b + 0.5))})


def profile_agreement(profiles: DataFrame, side: str, klass: str, value: str) -> DataFrame:
    """(side_a, side_b, n, spearman): rank agreement of class profiles between every two sides (seasons or schemes: a handful)."""
    known = profiles.where("estimable")
    left = known.select(F.col(side).alias("side_a"), klass, F.col(value).alias("__x"))
    right = known.select(F.col(side).alias("side_b"), klass, F.col(value).alias("__y"))
    return ranking.spearman(left.join(right, klass).where("side_a < side_b"), ["side_a", "side_b"], "__x", "__y")


def sample_inventory(presence: DataFrame, background: DataFrame, keys: list[str], item: str) -> DataFrame:
    """By key: distinct presence and background items, those in both, and background only."""
    both = presence.select(*keys, item).distinct().withColumn("__p", F.lit(1)).join(background.select(*keys, item).distinct().withColumn("__b", F.lit(1)), [*keys, item], "full_outer")
    p, b = F.col("__p").isNotNull(), F.col("__b").isNotNull()
    return both.groupBy(*keys).agg(F.count_if(p).alias("n_presence"), F.count_if(b).alias("n_background"), F.count_if(p & b).alias("n_overlap"), F.count_if(b & ~p).alias("n_background_only"))


def balance_weights(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, weight): half the rows' number over each class and membership's own."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__all"))
    return counts.crossJoin(F.broadcast(total)).select(*by, "n", (F.col("__all") * 0.5 / F.col("n")).alias("weight"))


def normalised_odds(log_odds: DataFrame, keys: list[str], value: str, cap: float = 8.0) -> DataFrame:
    """Odds over the largest of the group, from capped log-odds, and whether the cap was met."""
    capped = F.exp(F.least(F.greatest(F.col(value), F.lit(-cap)), F.lit(cap)))
    most = F.max("__odds").over(Window.partitionBy(*keys))
    return log_odds.withColumn("__odds", capped).withColumns({"odds": F.col("__odds") / most, "clipped": F.abs(F.col(value)) > cap}).drop("__odds")


def scenario_designs(spark: SparkSession, threats: list[tuple[str, float, float]], half_saturation: float) -> DataFrame:
    """(scenario, threat, max_dist, weight, half_saturation): the base, each field halved and doubled, each
    threat left out, half-saturation halved and doubled; weights are normalised to sum to one."""
    base = spark.createDataFrame(threats, "threat string, max_dist double, weight double")
    names = [t[0] for t in threats]
    rows = [("base", None, None, 1.0, 1.0)]
    rows += [(f"{n}_{field}_{tag}", n, field, f, 1.0) for n in names for field in ("weight", "max_dist") for tag, f in (("half", 0.5), ("double", 2.0))]
    rows += [(f"{n}_out", n, "out", 0.0, 1.0) for n in names]
    rows += [(f"half_saturation_{tag}", None, None, 1.0, f) for tag, f in (("half", 0.5), ("double", 2.0))]
    plan = spark.createDataFrame(rows, "scenario string, changed string, field string, factor double, k double")
    joined = plan.crossJoin(base).where(~((F.col("field") == "out") & (F.col("changed") == F.col("threat"))).eqNullSafe(F.lit(True)))
    mine = (F.col("changed") == F.col("threat")).eqNullSafe(F.lit(True))
    scaled = joined.withColumns({
        "__w": F.when(mine & (F.col("field") == "weight"), F.col("weight") * F.col("factor")).otherwise(F.col("weight")),
        "__d": F.when(mine & (F.col("field") == "max_dist"), F.col("max_dist") * F.col("factor")).otherwise(F.col("max_dist")),
    })
    w = Window.partitionBy("scenario")
    bounded = F.col("__w") / F.greatest(F.lit(1.0), F.max("__w").over(w))
    return scaled.withColumn("__b", bounded).select("scenario", "threat", F.col("__d").alias("max_dist"), (F.col("__b") / F.sum("__b").over(w)).alias("weight"), (F.col("k") * half_saturation).alias("half_saturation"))


def detection_grid(spark: SparkSession, probabilities: list[float], visits: list[int]) -> DataFrame:
    p = spark.createDataFrame([(float(x),) for x in probabilities], "p double")
    k = spark.createDataFrame([(int(x),) for x in visits], "k int")
    return p.crossJoin(k).select("p", "k", detection(F.col("p"), F.col("k")).alias("detection"))
