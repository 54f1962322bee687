"""All queries of the library by name, and the SQL each is held against."""

from __future__ import annotations

from tracewright.plans import graph_queries, log_queries, retrieval_queries, table_queries

PARTS = (log_queries, table_queries, graph_queries, retrieval_queries)


def queries():
    return {name: f for part in PARTS for name, (f, _) in part.QUERIES.items()}


def oracle_sql():
    return {name: text for part in PARTS for name, (_, text) in part.QUERIES.items() if text}
