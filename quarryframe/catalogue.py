"""All queries of the core package and their SQL."""

from __future__ import annotations

from . import queries_core, queries_facts, queries_general, queries_serving

_PARTS = (queries_core, queries_facts, queries_general, queries_serving)


def queries():
    return {k: v for p in _PARTS for k, v in p.QUERIES.items()}


def oracle_sql():
    return {k: v for p in _PARTS for k, v in p.SQL.items()}
