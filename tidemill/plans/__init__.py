"""Queries: operators bound to the tables, each with the SQL that DuckDB runs for comparison."""

from __future__ import annotations

from tidemill.plans import calls, compare, conversations, dialogue, documents, reliability, rules, runs, service, shop, state, texts, writes  # noqa: F401  they register themselves
from tidemill.registry import REGISTRY, Query


def queries() -> dict[str, Query]:
    return {name: o.build for name, o in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: o.oracle for name, o in REGISTRY.items() if o.oracle}
