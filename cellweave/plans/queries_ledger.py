"""Queries of the observation ledger: roll-ups, duplicates, memberships, review, readiness, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import keys
from cellweave.operators import ledger, validate, zonal
from cellweave.plans.views import with_views
from cellweave.sources.bridge import Bridge


def visit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.visit_counts(Bridge(spark, sf_dir).sightings(), ["season", "cell_id"], "visit")


def cell_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Bridge(spark, sf_dir).table("lineitem")
    return ledger.rollup(lines, ["l_partkey"], {"n_positive": F.col("l_quantity") >= 46}, {"n_suppliers": "l_suppkey"}, {"first_year": F.min(F.year("l_shipdate")), "last_year": F.max(F.year("l_shipdate"))}).withColumnRenamed("l_partkey", "cell_id")


def event_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events (site and date) with their first record's attributes and sums over all."""
    found = Bridge(spark, sf_dir).records().groupBy("event_key").agg(
        F.min_by("source_kind", "record_id").alias("first_source"), F.min_by("species", "record_id").alias("first_species"), F.count(F.lit(1)).alias("n_records"), F.count_distinct("species").alias("n_species"),
        (F.round(F.sum("abundance"), 4) + F.lit(0.0)).alias("abundance"), F.count_if(F.col("abundance") > 50).alias("n_large"),
    )
    return found.withColumn("event_id", keys.identity("ev_", F.col("event_key")))


def event_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.collisions(Bridge(spark, sf_dir).records(), "event_key")


def duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = Bridge(spark, sf_dir).table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return ledger.duplicate_flags(lines, ["l_orderkey", "l_linenumber", "l_returnflag"])


def season_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = Bridge(spark, sf_dir).table("orders").select(keys.season(F.col("o_orderdate")).alias("season"), keys.season_year(F.col("o_orderdate")).alias("season_year"), keys.season_year(F.col("o_orderdate"), True).alias("winter_year"))
    return days.groupBy("season", "season_year", "winter_year").agg(F.count(F.lit(1)).alias("n"))


def family_scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope of a species by a small dictionary, later rules over earlier ones; names that map twice are unknown."""
    names = spark.createDataFrame([("click", "core"), ("view", "core"), ("purchase", "associated"), ("error", "core"), ("error", "associated")], "species string, scope string")
    clear = names.groupBy("species").agg(F.when(F.count_distinct("scope") == 1, F.first("scope")).alias("scope"))
    rows = Bridge(spark, sf_dir).records().join(F.broadcast(clear), "species", "left")
    scope = F.when(F.col("scope") == "core", "core").when(F.col("scope") == "associated", "associated").when(F.col("species").isin("error"), "unknown").otherwise("outside")
    return rows.groupBy(scope.alias("family_scope"), "source_kind").agg(F.count(F.lit(1)).alias("n"))


def membership_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ledger.membership_summary(Bridge(spark, sf_dir).units(), "site_id", ["role", "season", "group_id"])
    return found.select("site_id", "n_memberships", F.array_join("role_set", ";").alias("roles"), F.array_join("season_set", ";").alias("seasons"), F.array_join("group_id_set", ";").alias("groups"), "conflict")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bridge(spark, sf_dir)
    summary = ledger.membership_summary(b.units().withColumn("site", F.col("site_id").cast("long")), "site", ["role", "season"])
    events = b.records().groupBy("event_key").agg(F.min("site").alias("site"), F.min("season").alias("season"))
    queue = ledger.review_queue(events, summary, "site")
    validate.require(validate.unlabelled_violations(queue))
    return queue.select("event_key", "site", "season", "n_memberships", "review_status", "eligible", "target")


def source_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.readiness(Bridge(spark, sf_dir).records(), "source_kind", "abundance", "duration")


def repeat_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.repeat_visits(Bridge(spark, sf_dir).records(), "site", "date", ["source_kind", "season"])


def season_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Bridge(spark, sf_dir).records()
    return rows.groupBy("season", "source_kind").agg(F.percentile("abundance", 0.5).alias("median_abundance"), F.count_distinct("site").alias("n_sites"), F.count_distinct(F.year("date")).alias("n_years"))


def positive_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that pass the positive, dated filter, by species."""
    return ledger.positive_dated(Bridge(spark, sf_dir).records()).groupBy("species").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def source_date_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.date_ranges(Bridge(spark, sf_dir).records().select("record_id", "source_kind", "date"), ["source_kind"], "date")


def event_ledger_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.event_violations(Bridge(spark, sf_dir).records(), "event_key", ["source_kind", "date"], "record_id")


def background_minus_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bridge(spark, sf_dir)
    return b.background_b0().join(b.presence(), ["season", "cell_id"], "left_anti").groupBy("season").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("cell_id").alias("cell_sum"))


def sample_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = Bridge(spark, sf_dir)
    return zonal.sample_inventory(b.presence(), b.background_b0(), ["season"], "cell_id")


def document_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 identity of each text's key and whether another document has it; a blank text has neither."""
    docs = Bridge(spark, sf_dir).docs().select("doc_id", keys.text_key(F.col("text")).alias("key")).withColumn("sha256", F.sha2("key", 256)).drop("key")
    flagged = ledger.duplicate_flags(docs, ["sha256"])
    return flagged.select("doc_id", "sha256", (F.col("is_duplicate") & F.col("sha256").isNotNull()).alias("is_duplicate"))


def source_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the set of sites of each source."""
    return Bridge(spark, sf_dir).records().select("source_kind", F.col("site").cast("string").alias("site")).distinct().groupBy("source_kind").agg(keys.set_digest(F.col("site")).alias("digest"), F.count(F.lit(1)).alias("n_sites"))


QUERIES = {f.__name__: f for f in (
    visit_cells, cell_rollup, event_rollup, event_collisions, duplicate_flags, season_year_counts, family_scope_counts, membership_summary, review_queue, source_readiness, repeat_visits, season_summary,
    positive_records, source_date_ranges, event_ledger_violations, background_minus_presence, sample_inventory, document_identity, source_digests,
)}

_SEASON = "CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring' WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer' WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'autumn' ELSE 'winter' END"
_SUMMARY = """SELECT site_id, count(*) AS n_memberships, list_sort(list(DISTINCT role)) AS r, list_sort(list(DISTINCT season)) AS s, list_sort(list(DISTINCT group_id)) AS g FROM units GROUP BY 1"""

ORACLE = {
    "visit_cells": with_views("SELECT season, cell_id, count(DISTINCT visit) AS visits FROM sightings GROUP BY ALL", "sightings"),
    "cell_rollup": "SELECT l_partkey AS cell_id, count(*) AS n_records, count(*) FILTER (WHERE l_quantity >= 46) AS n_positive, count(DISTINCT l_suppkey) AS n_suppliers, min(year(l_shipdate))::INT AS first_year, max(year(l_shipdate))::INT AS last_year FROM lineitem GROUP BY 1",
    "event_rollup": with_views("SELECT event_key, arg_min(source_kind, record_id) AS first_source, arg_min(species, record_id) AS first_species, count(*) AS n_records, count(DISTINCT species) AS n_species, round(sum(abundance), 4) + 0.0::DOUBLE AS abundance, count(*) FILTER (WHERE abundance > 50) AS n_large, 'ev_' || substr(sha256(event_key), 1, 20) AS event_id FROM records GROUP BY event_key", "records"),
    "event_collisions": with_views("SELECT event_key, count(*) AS n_rows FROM records GROUP BY 1 HAVING count(*) >= 2", "records"),
    "duplicate_flags": "SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag) > 1 AS is_duplicate FROM lineitem",
    "season_year_counts": f"SELECT {_SEASON} AS season, (year(o_orderdate) + (month(o_orderdate) = 12)::INT)::INT AS season_year, (year(o_orderdate) + (month(o_orderdate) = 12)::INT)::INT AS winter_year, count(*) AS n FROM orders GROUP BY ALL",
    "family_scope_counts": with_views("SELECT CASE WHEN species IN ('click', 'view') THEN 'core' WHEN species = 'purchase' THEN 'associated' WHEN species = 'error' THEN 'unknown' ELSE 'outside' END AS family_scope, source_kind, count(*) AS n FROM records GROUP BY ALL", "records"),
    "membership_summary": with_views(f"SELECT site_id, n_memberships, array_to_string(r, ';') AS roles, array_to_string(s, ';') AS seasons, array_to_string(g, ';') AS groups, len(r) <> 1 OR len(s) <> 1 OR len(g) <> 1 AS conflict FROM ({_SUMMARY})", "units"),
    "review_queue": with_views(f"""
SELECT event_key, site, season, coalesce(n_memberships, 0) AS n_memberships, CASE WHEN n_memberships IS NULL THEN 'no_membership' WHEN len(r) <> 1 OR len(s) <> 1 THEN 'conflict' ELSE 'single_membership' END AS review_status, false AS eligible, NULL::DOUBLE AS target
FROM (SELECT event_key, min(site) AS site, min(season) AS season FROM records GROUP BY 1) LEFT JOIN ({_SUMMARY}) ON site_id::BIGINT = site""", "units", "records"),
    "source_readiness": with_views("SELECT source_kind, count(*) AS n_records, count(*) FILTER (WHERE abundance > 0) AS n_positive, count(*) FILTER (WHERE abundance = 0) AS n_zero, count(*) FILTER (WHERE abundance < 0) AS n_negative, count(*) FILTER (WHERE abundance IS NULL) AS n_missing, count(*) FILTER (WHERE duration > 60) AS n_long, count(*) FILTER (WHERE duration IS NULL) AS n_no_duration FROM records GROUP BY 1", "records"),
    "repeat_visits": with_views("SELECT source_kind, season, count(*) AS n_sites, count(*) FILTER (WHERE n >= 2) AS n_twice, count(*) FILTER (WHERE n >= 3) AS n_thrice, max(n) AS most_dates FROM (SELECT source_kind, season, site, count(DISTINCT date) AS n FROM records GROUP BY ALL) GROUP BY ALL", "records"),
    "season_summary": with_views("SELECT season, source_kind, median(abundance) AS median_abundance, count(DISTINCT site) AS n_sites, count(DISTINCT year(date)) AS n_years FROM records GROUP BY ALL", "records"),
    "positive_records": with_views("SELECT species, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM records WHERE abundance > 0 AND date IS NOT NULL GROUP BY 1", "records"),
    "source_date_ranges": with_views("SELECT source_kind, record_id, date, min(date) OVER (PARTITION BY source_kind) AS first_date, max(date) OVER (PARTITION BY source_kind) AS last_date FROM records", "records"),
    "event_ledger_violations": with_views("""
SELECT 'blank_event' AS rule, count(*) FILTER (WHERE event_key IS NULL OR trim(event_key) = '') AS n_violations FROM records
UNION ALL SELECT 'blank_record', count(*) FILTER (WHERE record_id IS NULL) FROM records
UNION ALL SELECT 'repeated_record', count(*) FROM (SELECT 1 FROM records GROUP BY record_id HAVING count(*) > 1)
UNION ALL SELECT 'event_with_several_source_kind', count(*) FROM (SELECT 1 FROM records GROUP BY event_key HAVING count(DISTINCT source_kind) > 1)
UNION ALL SELECT 'event_with_several_date', count(*) FROM (SELECT 1 FROM records GROUP BY event_key HAVING count(DISTINCT date) > 1)""", "records"),
    "background_minus_presence": with_views("SELECT season, count(*) AS n_cells, sum(cell_id)::BIGINT AS cell_sum FROM background_b0 ANTI JOIN presence USING (season, cell_id) GROUP BY 1", "background_b0", "presence"),
    "sample_inventory": with_views("SELECT season, count(p) AS n_presence, count(b) AS n_background, count(p + b) AS n_overlap, count(*) FILTER (WHERE b IS NOT NULL AND p IS NULL) AS n_background_only FROM (SELECT *, 1 AS p FROM presence) FULL JOIN (SELECT *, 1 AS b FROM background_b0) USING (season, cell_id) GROUP BY 1", "background_b0", "presence"),
    "document_identity": r"""
WITH k AS (SELECT doc_id, sha256(nullif(lower(regexp_replace(text, '[\t-\r ]+', '', 'g')), '')) AS sha256 FROM documents)
SELECT doc_id, sha256, sha256 IS NOT NULL AND count(*) OVER (PARTITION BY sha256) > 1 AS is_duplicate FROM k""",
    "source_digests": with_views("SELECT source_kind, sha256(array_to_string(list_sort(list(DISTINCT site::VARCHAR)), chr(10))) AS digest, count(DISTINCT site) AS n_sites FROM records GROUP BY 1", "records"),
}
