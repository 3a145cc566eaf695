"""All queries of the engine by name, each with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from ripplework.plans import checks, inventory, ordered, positions, records, relational, storage, texts, vectors  # noqa: F401  they register their queries
from ripplework.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
