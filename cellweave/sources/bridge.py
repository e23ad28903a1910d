"""Domain views over the star-schema test tables.

Every query and its SQL counterpart start from these: the frames below and the
statements in ``cellweave.plans.views`` say the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.grid import Grid
from cellweave.functions.keys import season

#: The part table as a grid, 50 cells wide.
WIDTH = 50
ORIGIN = (650_000.0, 3_870_000.0)
PREDICTORS = ("size", "price", "qty", "disc", "tax", "lst_day", "lst_night")


def avg9(column: str) -> Column:
    """An average, rounded so that the order of summation leaves no trace; -0.0 becomes 0.0."""
    return F.round(F.avg(column), 9) + F.lit(0.0)


class Bridge:
    """The views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def grid(self) -> Grid:
        """The grid of the cells; its height comes from the part keys."""
        top = self.table("part").agg(F.max("p_partkey")).first()[0] or 0
        return Grid(WIDTH, top // WIDTH + 1, *ORIGIN)

    def units(self) -> DataFrame:
        """One row for each survey unit (the sample table)."""
        lines = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.round(F.avg("l_quantity") / 50.0, 9).alias("m0"), avg9("l_discount").alias("u_h"), avg9("l_tax").alias("u_m"),
            F.min("l_returnflag").alias("flag"), F.min("l_partkey").alias("partkey"),
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        customer = self.table("customer").select("c_custkey", "c_nationkey")
        part = self.table("part").select("p_partkey", "p_size")
        joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(part, F.col("partkey") == F.col("p_partkey"))
        reference = F.when(F.col("p_size") % 10 == 0, 0.0).otherwise(F.col("p_size") / 50.0)
        nation = F.col("c_nationkey") % 5
        return joined.select(
            F.concat_ws("_", "l_orderkey", "l_linenumber").alias("sample_id"), F.col("o_custkey").cast("string").alias("site_id"),
            F.concat(F.lit("b"), F.col("c_nationkey").cast("string")).alias("group_id"), F.year("o_orderdate").alias("year"), season(F.col("o_orderdate")).alias("season"),
            F.when(nation == 0, "test").when(nation == 1, "validation").otherwise("train").alias("role"),
            F.when(F.col("l_orderkey") % 97 != 0, F.col("m0")).alias("m"), reference.alias("habitat_suitability"),
            F.round(reference * (1.0 - F.least(F.lit(1.0), 10.0 * F.col("u_h"))), 9).alias("h"),
            F.when(F.col("flag") == "R", 0).otherwise(1).alias("feasible"), "u_m", "u_h", "l_orderkey",
        )

    def targets(self) -> DataFrame:
        """Units with exercise targets, derived from m and h on purpose."""
        clip = lambda c: F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
        m, low = F.col("m"), 1.0 - F.col("h")
        return self.units().withColumns({
            "target_protection": F.when(F.col("l_orderkey") % 5 != 0, clip(F.round(0.10 + 0.76 * m - 0.20 * low, 9))),
            "target_restoration": F.when(F.col("feasible") == 1, clip(F.round(0.04 + 0.57 * m + 0.25 * low, 9))),
        })

    def cells(self) -> DataFrame:
        """The wide cell table with predictors and threat layers.

        Merged, not broadcast: a filter on a layer makes the join an inner one, and the
        size of the part file tells little of its rows in memory.
        """
        lines = self.table("lineitem").groupBy("l_partkey").agg(avg9("l_quantity").alias("qty"), avg9("l_discount").alias("disc"), avg9("l_tax").alias("tax"), F.round(F.avg("l_extendedprice"), 6).alias("lst_day"))
        part = self.table("part").select("p_partkey", "p_size", "p_retailprice")
        row, column = F.floor(F.col("p_partkey") / WIDTH), F.col("p_partkey") % WIDTH
        return part.join(lines.hint("merge"), part.p_partkey == lines.l_partkey, "left").select(
            F.col("p_partkey").alias("cell_id"), row.alias("row"), column.alias("col"),
            (ORIGIN[0] + (column + 0.5) * 100.0).alias("x"), (ORIGIN[1] - (row + 0.5) * 100.0).alias("y"),
            (F.col("p_partkey") % 37 != 0).alias("valid"), (1 + F.col("p_size") % 9).alias("lucode"),
            F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"), "qty", "disc", "tax", "lst_day", (0.5 * F.col("lst_day")).alias("lst_night"),
            F.round((F.col("p_retailprice") - 900.0) / 100.0, 9).alias("urban"), F.round(F.when(F.col("disc").isNotNull(), F.least(F.lit(1.0), 10.0 * F.col("disc"))), 9).alias("light"),
        )

    def sightings(self) -> DataFrame:
        """Survey lines with their season: (season, cell_id, visit, positive)."""
        positive = (F.col("l_returnflag") == "A") & (F.col("l_quantity") >= 46)
        return self.table("lineitem").select(season(F.col("l_shipdate")).alias("season"), F.col("l_partkey").alias("cell_id"), F.col("l_orderkey").alias("visit"), positive.alias("positive"))

    def presence(self) -> DataFrame:
        return self.sightings().where("positive").select("season", "cell_id").distinct()

    def background_b0(self) -> DataFrame:
        return self.sightings().select("season", "cell_id").distinct()

    def visits(self) -> DataFrame:
        return self.sightings().groupBy("season", "cell_id").agg(F.count_distinct("visit").alias("visits"))

    def members(self) -> DataFrame:
        """Scores of the ensemble members: (season, cell_id, member, score)."""
        return self.table("lineitem").groupBy(season(F.col("l_shipdate")).alias("season"), F.col("l_partkey").alias("cell_id"), (F.col("l_suppkey") % 3).alias("member")).agg(F.round(F.avg("l_quantity") / 50.0, 9).alias("score"))

    def scored(self) -> DataFrame:
        """Presence and background scores: (season, fold, positive, score)."""
        return self.table("lineitem").select(season(F.col("l_shipdate")).alias("season"), (F.col("l_suppkey") % 3).alias("fold"), (F.col("l_returnflag") == "A").alias("positive"), F.round((F.col("l_quantity") - 1.0) / 49.0, 9).alias("score"))

    def candidates(self) -> DataFrame:
        """Candidate settings with the metrics of each inner fold."""
        i = F.col("event_id")
        div = lambda a, b: F.floor(a / b)
        pick = lambda values, at: F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))
        keyed = self.table("events").select(
            F.concat(F.lit("v"), (i % 2).cast("string")).alias("variant"), pick(("B0", "B1", "B2"), div(i, 2) % 3).alias("background"), pick((0.5, 1.0, 2.0, 4.0), div(i, 6) % 4).alias("rm"),
            pick(("L", "LQ", "LQH"), div(i, 24) % 3).alias("fc"), (div(i, 72) % 3).cast("int").alias("inner_fold"), pick(("spring", "summer", "autumn", "winter"), div(i, 216) % 4).alias("season"), "value",
        )
        rolled = keyed.groupBy("season", "variant", "background", "rm", "fc", "inner_fold").agg(F.avg("value").alias("v"), F.avg((F.col("value") > 60).cast("double")).alias("o"), F.count(F.lit(1)).alias("complexity"))
        auc = F.round(F.col("v") / (F.col("v") + 50.0), 9)
        return rolled.select("season", "variant", "background", "rm", "fc", "inner_fold", auc.alias("validation_auc"), F.round("o", 9).alias("omission_10"), "complexity", F.round(0.5 - auc, 9).alias("auc_gap"))

    def records(self) -> DataFrame:
        """The observation ledger."""
        kind = F.when(F.col("event_type").isin("view", "click"), "nd").when(F.col("event_type") == "purchase", "monitoring").otherwise("zhuque")
        day = F.to_date("ts")
        return self.table("events").select(
            F.col("event_id").alias("record_id"), kind.alias("source_kind"), F.col("event_type").alias("species"), F.col("user_id").alias("site"), day.alias("date"),
            F.col("value").alias("abundance"), F.get_json_object("props", "$.k").cast("double").alias("duration"), F.concat_ws("|", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("event_key"), season(day).alias("season"),
        )

    def docs(self) -> DataFrame:
        return self.table("documents").select("doc_id", "text", "source")
