"""Fail-closed validation: rules become one aggregate, counts of violations become a table or an error."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.keys import blank
from cellweave.functions.scores import SEASONS, TOLERANCE


class ValidationError(ValueError):
    """A table breaks a rule; the message names the rules and counts."""


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n_violations) of row rules, in one pass; an unknown outcome counts as broken."""
    found = df.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in rules.items()))
    return found.select(F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("n_violations")) for n in rules))).alias("v")).select("v.*")


def repeated_keys(df: DataFrame, rule: str, columns: list[str]) -> DataFrame:
    """(rule, n_violations): keys that more than one row holds."""
    repeated = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return repeated.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n_violations"))


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValidationError(f"missing columns: {', '.join(missing)}")


def require(found: DataFrame) -> None:
    """An error if any rule of a violations table is broken."""
    broken = {r["rule"]: r["n_violations"] for r in found.where("n_violations > 0").collect()}
    if broken:
        raise ValidationError("; ".join(f"{rule}: {n}" for rule, n in sorted(broken.items())))


def outside_unit(c: str, allow_null: bool = False) -> Column:
    bad = ~F.col(c).between(0.0, 1.0) | F.isnan(c)
    return F.coalesce(bad, F.lit(not allow_null))


SAMPLE_COLUMNS = ("sample_id", "site_id", "group_id", "year", "season", "m", "h", "habitat_suitability", "u_m", "u_h", "feasible")


def sample_rules(training: bool = False, m_may_be_null: bool = False) -> dict[str, Column]:
    """Row rules of the sample table."""
    rules = {f"blank_{c}": blank(F.col(c)) for c in ("sample_id", "site_id", "group_id")}
    rules |= {"missing_year": F.col("year").isNull(), "unknown_season": ~F.coalesce(F.col("season").isin(*SEASONS), F.lit(False))}
    rules |= {f"{c}_outside_unit": outside_unit(c, m_may_be_null and c == "m") for c in ("m", "h", "habitat_suitability")}
    rules |= {f"{c}_negative": F.coalesce((F.col(c) < 0) | F.isnan(c) | (F.col(c) == float("inf")), F.lit(True)) for c in ("u_m", "u_h")}
    rules |= {"feasible_not_binary": ~F.coalesce(F.col("feasible").isin(0, 1), F.lit(False)), "h_above_reference": F.coalesce(F.col("h") > F.col("habitat_suitability") + TOLERANCE, F.lit(False))}
    if training:
        rules |= {"unknown_role": ~F.coalesce(F.col("role").isin("train", "validation", "test"), F.lit(False))}
        rules |= {f"{c}_outside_unit": outside_unit(c, True) for c in ("target_protection", "target_restoration")}
    return rules


def sample_violations(df: DataFrame, training: bool = False, m_may_be_null: bool = False) -> DataFrame:
    require_columns(df, SAMPLE_COLUMNS + (("role",) if training else ()))
    natural = ["site_id", "year", "season"] + (["species_id"] if "species_id" in df.columns else [])
    found = violations(df, sample_rules(training, m_may_be_null))
    return found.unionByName(repeated_keys(df, "repeated_sample_id", ["sample_id"])).unionByName(repeated_keys(df, "repeated_natural_key", natural))


def cell_violations(table: DataFrame, cells: DataFrame, width: int, height: int) -> DataFrame:
    """Rules of a cell table against the grid's valid cells."""
    inside = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)
    known = cells.where("valid").select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col("x").alias("__x"), F.col("y").alias("__y"))
    joined = table.join(known, (F.col("row") == F.col("__r")) & (F.col("col") == F.col("__c")), "left")
    rules = {
        "outside_grid": ~inside,
        "outside_mask": F.col("__x").isNull(),
        "off_centre": F.col("__x").isNotNull() & ((F.abs(F.col("x") - F.col("__x")) > 0.01) | (F.abs(F.col("y") - F.col("__y")) > 0.01)),
    }
    return violations(joined, rules).unionByName(repeated_keys(table, "repeated_cell", ["row", "col"])).unionByName(repeated_keys(table, "repeated_id", ["cell_id"]))


def event_violations(ledger: DataFrame, event: str, single: list[str], record: str) -> DataFrame:
    """Rules of the event ledger: ids present and unique, each event with one value of each column (NULL is a value)."""
    parts = violations(ledger, {"blank_event": blank(F.col(event).cast("string")), "blank_record": blank(F.col(record).cast("string"))}).unionByName(repeated_keys(ledger, "repeated_record", [record]))
    for c in single:
        by = ledger.groupBy(event).agg((F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias("n")).where("n > 1")
        parts = parts.unionByName(by.agg(F.lit(f"event_with_several_{c}").alias("rule"), F.count(F.lit(1)).alias("n_violations")))
    return parts


def parameter_violations(threats: DataFrame, pixel: float) -> DataFrame:
    """Rules of each member's threats: weights in [0, 1] with a positive sum, distances, decay."""
    row = violations(threats, {
        "weight_outside_unit": outside_unit("weight"), "distance_below_pixel": ~F.coalesce(F.col("max_dist").between(pixel, 1e300), F.lit(False)),
        "unknown_decay": ~F.coalesce(F.col("decay").isin("linear", "exponential"), F.lit(False)),
    })
    sums = threats.groupBy("member_id").agg(F.sum("weight").alias("s")).where(~F.coalesce(F.col("s") > 0, F.lit(False)))
    return row.unionByName(sums.agg(F.lit("no_weight").alias("rule"), F.count(F.lit(1)).alias("n_violations")))


def codes_without(codes: DataFrame, registry: DataFrame, code: str) -> DataFrame:
    """Codes that have no confirmed, named and evidenced entry in the registry."""
    good = registry.where((F.col("status") == "confirmed") & ~blank(F.col("name")) & ~blank(F.col("evidence"))).select(code)
    return codes.select(code).distinct().join(good, code, "left_anti")


def unlabelled_violations(review: DataFrame) -> DataFrame:
    """No labels, no targets, nothing eligible."""
    return violations(review, {"label_made": F.col("target").isNotNull(), "marked_eligible": F.coalesce(F.col("eligible"), F.lit(True))})


def differs(a: Column, b: Column, rtol: float = 1e-6, atol: float = 1e-7) -> Column:
    """Whether two values disagree: one missing, or apart by more than the tolerance."""
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > atol + rtol * F.abs(b), F.lit(False))


def swd_violations(samples: DataFrame, predictors: list[str], nodata: float = -9999.0) -> DataFrame:
    """Rules of a samples-with-data table: finite numbers, no no-data value, places on the globe, a species."""
    rules = {"blank_species": blank(F.col("species")), "longitude_outside": ~F.col("longitude").between(-180, 180), "latitude_outside": ~F.col("latitude").between(-90, 90)}
    rules |= {f"{p}_not_finite": F.coalesce(F.isnan(p) | (F.abs(p) == float("inf")), F.lit(True)) for p in predictors}
    rules |= {f"{p}_no_data": F.coalesce(F.col(p) == nodata, F.lit(True)) for p in predictors}
    return violations(samples, rules)


def layer_violations(cells: DataFrame, code: str, threats: list[str], mask: str) -> DataFrame:
    """Rules of source layers: whole class codes, threats known and in [0, 1] under the mask; zero is a value."""
    inside = F.coalesce(F.col(mask), F.lit(False))
    rules = {f"{code}_fractional": inside & F.coalesce(F.col(code) != F.floor(code), F.lit(True))}
    rules |= {f"{t}_outside_unit": inside & outside_unit(t) for t in threats}
    return violations(cells, rules)
