"""DuckDB statements of the domain views, composed into WITH clauses."""

from __future__ import annotations


def season_sql(day: str) -> str:
    return f"CASE WHEN month({day}) BETWEEN 3 AND 5 THEN 'spring' WHEN month({day}) BETWEEN 6 AND 8 THEN 'summer' WHEN month({day}) BETWEEN 9 AND 11 THEN 'autumn' WHEN {day} IS NOT NULL THEN 'winter' END"


VIEWS = {
    "units": ((), f"""
SELECT l.l_orderkey || '_' || l.l_linenumber AS sample_id, o_custkey::VARCHAR AS site_id, 'b' || c_nationkey AS group_id, year(o_orderdate)::INT AS year, {season_sql("o_orderdate")} AS season,
       CASE c_nationkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS role,
       CASE WHEN l.l_orderkey % 97 <> 0 THEN m0 END AS m, hs AS habitat_suitability,
       round(hs * (1.0::DOUBLE - least(1.0::DOUBLE, 10.0::DOUBLE * u_h)), 9) AS h, CASE WHEN flag = 'R' THEN 0 ELSE 1 END AS feasible, u_m, u_h, l.l_orderkey
FROM (SELECT l_orderkey, l_linenumber, round(avg(l_quantity) / 50, 9) AS m0, round(avg(l_discount), 9) + 0.0::DOUBLE AS u_h, round(avg(l_tax), 9) + 0.0::DOUBLE AS u_m, min(l_returnflag) AS flag, min(l_partkey) AS partkey
      FROM lineitem GROUP BY ALL) l
JOIN orders ON o_orderkey = l.l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN (SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN 0.0::DOUBLE ELSE p_size / 50.0::DOUBLE END AS hs FROM part) ON p_partkey = partkey"""),
    "targets": (("units",), """
SELECT *, CASE WHEN l_orderkey % 5 <> 0 AND m IS NOT NULL THEN least(greatest(round(0.10::DOUBLE + 0.76::DOUBLE * m - 0.20::DOUBLE * (1.0::DOUBLE - h), 9), 0.0::DOUBLE), 1.0::DOUBLE) END AS target_protection,
       CASE WHEN feasible = 1 AND m IS NOT NULL THEN least(greatest(round(0.04::DOUBLE + 0.57::DOUBLE * m + 0.25::DOUBLE * (1.0::DOUBLE - h), 9), 0.0::DOUBLE), 1.0::DOUBLE) END AS target_restoration
FROM units"""),
    "cells": ((), """
SELECT p_partkey AS cell_id, p_partkey // 50 AS "row", p_partkey % 50 AS col, 650000.0::DOUBLE + (p_partkey % 50 + 0.5::DOUBLE) * 100 AS x, 3870000.0::DOUBLE - (p_partkey // 50 + 0.5::DOUBLE) * 100 AS y,
       p_partkey % 37 <> 0 AS valid, 1 + p_size % 9 AS lucode, p_size::DOUBLE AS size, p_retailprice AS price, qty, disc, tax, lst_day, 0.5::DOUBLE * lst_day AS lst_night,
       round((p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE, 9) AS urban, round(CASE WHEN disc IS NOT NULL THEN least(1.0::DOUBLE, 10.0::DOUBLE * disc) END, 9) AS light
FROM part LEFT JOIN (SELECT l_partkey, round(avg(l_quantity), 9) + 0.0::DOUBLE AS qty, round(avg(l_discount), 9) + 0.0::DOUBLE AS disc, round(avg(l_tax), 9) + 0.0::DOUBLE AS tax, round(avg(l_extendedprice), 6) AS lst_day
                     FROM lineitem GROUP BY 1) ON l_partkey = p_partkey"""),
    "sightings": ((), f"""
SELECT {season_sql("l_shipdate")} AS season, l_partkey AS cell_id, l_orderkey AS visit, l_returnflag = 'A' AND l_quantity >= 46 AS positive FROM lineitem"""),
    "presence": (("sightings",), "SELECT DISTINCT season, cell_id FROM sightings WHERE positive"),
    "background_b0": (("sightings",), "SELECT DISTINCT season, cell_id FROM sightings"),
    "visits": (("sightings",), "SELECT season, cell_id, count(DISTINCT visit) AS visits FROM sightings GROUP BY ALL"),
    "members": ((), f"""
SELECT {season_sql("l_shipdate")} AS season, l_partkey AS cell_id, l_suppkey % 3 AS member, round(avg(l_quantity) / 50, 9) AS score FROM lineitem GROUP BY ALL"""),
    "scored": ((), f"""
SELECT {season_sql("l_shipdate")} AS season, l_suppkey % 3 AS fold, l_returnflag = 'A' AS positive, round((l_quantity - 1) / 49, 9) AS score FROM lineitem"""),
    "candidates": ((), """
SELECT season, variant, background, rm, fc, inner_fold, round(v / (v + 50), 9) AS validation_auc, round(o, 9) AS omission_10, complexity, round(0.5::DOUBLE - round(v / (v + 50), 9), 9) AS auc_gap
FROM (SELECT ['spring', 'summer', 'autumn', 'winter'][1 + event_id // 216 % 4] AS season, 'v' || event_id % 2 AS variant, ['B0', 'B1', 'B2'][1 + event_id // 2 % 3] AS background,
             [0.5::DOUBLE, 1, 2, 4][1 + event_id // 6 % 4] AS rm, ['L', 'LQ', 'LQH'][1 + event_id // 24 % 3] AS fc, (event_id // 72 % 3)::INT AS inner_fold,
             avg(value) AS v, avg((value > 60)::INT) AS o, count(*) AS complexity FROM events GROUP BY ALL)"""),
    "records": ((), f"""
SELECT event_id AS record_id, CASE WHEN event_type IN ('view', 'click') THEN 'nd' WHEN event_type = 'purchase' THEN 'monitoring' ELSE 'zhuque' END AS source_kind, event_type AS species, user_id AS site,
       ts::DATE AS date, value AS abundance, json_extract_string(props, '$.k')::DOUBLE AS duration, user_id || '|' || strftime(ts, '%Y-%m-%d') AS event_key, {season_sql("ts")} AS season FROM events"""),
    "docs": ((), "SELECT doc_id, text, source FROM documents"),
}


def with_views(sql: str, *names: str) -> str:
    """The statement under a WITH clause of the named views and what they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in VIEWS[name][0]:
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    clause = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order)
    body = sql.strip()
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {clause},\n{body[15:]}"
    return f"WITH {clause},\n{body[5:]}" if body.startswith("WITH ") else f"WITH {clause}\n{body}"
