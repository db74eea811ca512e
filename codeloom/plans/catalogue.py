"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from codeloom.plans import core_problems, graph_queries, index_queries, ingest_queries, lookup_queries, search_queries

MODULES = [core_problems, search_queries, graph_queries, index_queries, ingest_queries, lookup_queries]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def flagship(spark, directory):
    return search_queries.QUERIES["f1_find_type_exact"](spark, directory)
