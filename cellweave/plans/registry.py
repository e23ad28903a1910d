"""All registered queries of the core library and their DuckDB statements."""

from __future__ import annotations

from cellweave.plans import queries_ledger, queries_models, queries_ranks, queries_scores, queries_spatial

_MODULES = (queries_scores, queries_ledger, queries_ranks, queries_spatial, queries_models)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
