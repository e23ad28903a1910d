"""Registered queries of the package and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from cellweave.llm import queries_mixing, queries_pii, queries_products, queries_quality, queries_repetition, queries_resampling, queries_sessions, queries_set_join, queries_simhash, queries_substring, queries_tokens, queries_urls

_MODULES = (queries_quality, queries_substring, queries_repetition, queries_tokens, queries_urls, queries_simhash, queries_mixing, queries_products, queries_pii, queries_resampling, queries_sessions, queries_set_join)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
