"""Driver queries of the monitoring operators, and SQL for the same rows."""

from __future__ import annotations

from driftlane.plans import data, drift, preparation, vectors  # noqa: F401  they register their queries
from driftlane.plans.registry import ORACLE, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
