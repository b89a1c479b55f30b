"""All queries of the library proper, by name, with the SQL that states the same result."""

from __future__ import annotations

from . import aggregates, event_suite, joins, nested, scans, sets, subqueries, tpch, windows  # noqa: F401  each registers its queries
from .catalog import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
