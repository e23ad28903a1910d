"""Every registered core query against its SQL on DuckDB, and the shape of those without SQL."""

import pytest

from cellweave.plans.registry import ORACLE, QUERIES
from tools.compare import compare, connect

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert compare(spark, duck, name, QUERIES[name], ORACLE[name], SF) == ""


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_split_plan_keeps_groups_apart(spark):
    rows = QUERIES["split_plan"](spark, SF).collect()
    assert {(r.outer, r.inner) for r in rows} == {(o, i) for o in range(3) for i in range(-1, 3)}
    assert all(r.n_cells > 0 for r in rows)


def test_balanced_assignment_is_near_its_shares(spark):
    parts = {r.group_id: r.part for r in QUERIES["balanced_assignment"](spark, SF).collect()}
    again = {r.group_id: r.part for r in QUERIES["balanced_assignment"](spark, SF).collect()}
    assert parts == again and set(parts.values()) == {0, 1, 2}
    assert 0.4 <= sum(p == 0 for p in parts.values()) / len(parts) <= 0.8


def test_fits(spark):
    vif = {r.predictor: r.vif for r in QUERIES["vif"](spark, SF).collect()}
    assert vif["lst_day"] is None and vif["lst_night"] is None and vif["size"] >= 1
    kept = {r.predictor for r in QUERIES["predictor_screen"](spark, SF).collect() if r.kept}
    assert "lst_day" in kept and "lst_night" not in kept
    weights = {(r.target, r.method): r.weight for r in QUERIES["constant_weights"](spark, SF).collect()}
    assert all(0.1 <= w <= 0.9 for w in weights.values()) and len(weights) == 4
    assert {r.term for r in QUERIES["logistic_ridge"](spark, SF).collect()} == {"intercept", "size", "urban", "light"}


def test_gate_scores(spark):
    from pyspark.sql import functions as F

    out = QUERIES["gate_scores"](spark, "/root/testdata/sf0.001")
    row = out.agg(F.min("conservation").alias("a"), F.max("conservation").alias("b"), F.min("w_protection").alias("c"), F.max("w_restoration").alias("d"), F.count_if("conservation IS NULL" if False else F.col("conservation").isNull()).alias("n")).first()
    assert 0 <= row.a <= row.b <= 1 and row.c >= 0.1 and row.d <= 0.9 and row.n > 0
