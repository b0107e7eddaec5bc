"""Every registered query with its oracle SQL, by key."""

from __future__ import annotations

from corpusindex.jobs import ask_queries, decision_queries, front_queries, functional_queries, index_queries, java_queries, retrieval_queries, source_queries, web_queries

MODULES = (retrieval_queries, decision_queries, java_queries, functional_queries, web_queries, front_queries, source_queries, ask_queries, index_queries)


def queries() -> dict:
    return {key: query for module in MODULES for key, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {key: sql for module in MODULES for key, sql in module.ORACLE.items()}
