"""Observation ledger: filters, event and cell roll-ups, duplicates, memberships and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def positive_dated(records: DataFrame, abundance: str = "abundance", date: str = "date", longitude: str | None = None, latitude: str | None = None) -> DataFrame:
    """Records with a positive number and a date (and a place on the globe, where columns are given)."""
    keep = (F.col(abundance).try_cast("double") > 0) & F.col(date).isNotNull()
    if longitude and latitude:
        keep = keep & F.col(longitude).try_cast("double").between(-180, 180) & F.col(latitude).try_cast("double").between(-90, 90)
    return records.where(keep)


def visit_counts(visits: DataFrame, groups: list[str], visit: str) -> DataFrame:
    """Distinct visits of each group."""
    return visits.groupBy(*groups, visit).agg(F.lit(1).alias("__1")).groupBy(*groups).agg(F.count(F.lit(1)).alias("visits"))


def rollup(records: DataFrame, keys: list[str], counts: dict[str, Column], distinct: dict[str, str] | None = None, extremes: dict[str, Column] | None = None) -> DataFrame:
    """Counts of conditions, distinct values and extremes by key, with NULL keys as a group of their own."""
    aggregates = [F.count(F.lit(1)).alias("n_records")]
    aggregates += [F.count_if(c).alias(n) for n, c in counts.items()]
    aggregates += [F.count_distinct(c).alias(n) for n, c in (distinct or {}).items()]
    aggregates += [c.alias(n) for n, c in (extremes or {}).items()]
    return records.groupBy(*keys).agg(*aggregates)


def duplicate_flags(rows: DataFrame, columns: list[str], name: str = "is_duplicate") -> DataFrame:
    """Rows with a flag: does another row agree in all the columns (NULL equals NULL)?

    Repeated keys are counted before the join, so a hot key is one row.
    """
    repeated = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(columns)), F.lit(True).alias("__twice"))
    on = F.lit(True)
    for i, c in enumerate(columns):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(repeated, on, "left").withColumn(name, F.coalesce("__twice", F.lit(False))).select(*rows.columns, name)


def collisions(rows: DataFrame, key: str, least: int = 2) -> DataFrame:
    """Keys (not NULL) that `least` or more rows share, with their number."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") >= least)


def membership_summary(memberships: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Sorted distinct values of each column by key, and whether the key's memberships conflict."""
    sets = [F.array_sort(F.collect_set(c)).alias(f"{c}_set") for c in columns]
    found = memberships.groupBy(key).agg(F.count(F.lit(1)).alias("n_memberships"), *sets)
    conflict = F.lit(False)
    for c in columns:
        conflict = conflict | (F.size(f"{c}_set") != 1)
    return found.withColumn("conflict", conflict)


def review_queue(events: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Every event with its review status; nothing is eligible and no label is made."""
    joined = events.join(summary, key, "left")
    status = F.when(F.col("n_memberships").isNull(), "no_membership").when(F.col("conflict"), "conflict").otherwise("single_membership")
    return joined.select(
        *events.columns, F.coalesce("n_memberships", F.lit(0)).alias("n_memberships"), status.alias("review_status"),
        F.lit(False).alias("eligible"), F.lit(None).cast("double").alias("target"),
    )


def readiness(records: DataFrame, by: str, abundance: str, duration: str) -> DataFrame:
    """Conditional counts by source."""
    a, d = F.col(abundance), F.col(duration)
    return rollup(records, [by], {"n_positive": a > 0, "n_zero": a == 0, "n_negative": a < 0, "n_missing": a.isNull(), "n_long": d > 60, "n_no_duration": d.isNull()})


def repeat_visits(records: DataFrame, site: str, date: str, keys: list[str]) -> DataFrame:
    """By key: sites, and those with two and three or more different dates."""
    dates = records.groupBy(*keys, site).agg(F.count_distinct(date).alias("n_dates"))
    return dates.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_sites"), F.count_if(F.col("n_dates") >= 2).alias("n_twice"), F.count_if(F.col("n_dates") >= 3).alias("n_thrice"), F.max("n_dates").alias("most_dates"))


def date_ranges(records: DataFrame, keys: list[str], date: str) -> DataFrame:
    """Records with their source's first and last date."""
    w = records.groupBy(*keys).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
    return records.join(w, keys)


def contiguous(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Keys whose numbers are not 0, 1, 2, ... without gap or repetition."""
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.col(order) - F.lag(order, 1, -1).over(w)
    return rows.withColumn("__step", step).groupBy(*keys).agg(F.count_if(F.col("__step") != 1).alias("n_breaks")).where("n_breaks > 0")
