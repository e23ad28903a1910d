"""Physical plans that have to hold at a larger scale."""

import re

import pytest

from cellweave.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def plan(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def scanned(text, table):
    found = [s for s in text.split("\n") if "FileScan" in s and f"/{table}.parquet" in s]
    return [set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<(.*?)>", s)[1])) for s in found]


def test_scans_read_only_what_a_query_needs(spark):
    text = plan(spark, "zones_by_season")
    assert scanned(text, "lineitem") == [{"l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_returnflag"}]
    assert scanned(text, "orders") == [{"o_orderkey", "o_custkey", "o_orderdate"}]
    assert scanned(plan(spark, "positive_records"), "events") == [{"ts", "event_type", "value"}]


def test_filters_reach_the_scan(spark):
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_quantity)" in plan(spark, "background_minus_presence")


@pytest.mark.parametrize("name", ["auc_by_fold", "spearman_pairs", "topk_overlap", "duplicate_flags", "event_rollup", "member_quantiles", "buffer_exclusion", "grid_sample", "visit_cells"])
def test_no_task_sees_all_rows(spark, name):
    text = plan(spark, name)
    assert "SinglePartition" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["visit_cells", "event_rollup", "cell_rollup", "zones_by_season", "season_year_counts"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    text = plan(spark, name)
    for at in [m.start() for m in re.finditer("Exchange hashpartitioning", text)]:
        assert re.match(r"[^\n]*\n[^\n]*(Aggregate|Project)", text[at:])
