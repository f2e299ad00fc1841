"""All core queries and their SQL, gathered from the binding modules."""

from __future__ import annotations

from importlib import import_module

MODULES = ("trace_queries", "delivery_queries", "scalar_queries", "page_queries", "report_queries", "compose_queries")


def gather() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in MODULES:
        m = import_module(f"quillspark.plans.{name}")
        queries.update(m.QUERIES)
        sql.update(m.SQL)
    return queries, sql
