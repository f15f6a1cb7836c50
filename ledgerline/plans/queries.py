"""Queries of the reconciliation, delta, transformation and SQL operators, each with its DuckDB twin."""

from __future__ import annotations

from . import chains, deltas, exact, reconciliation, records, sql, tables, transforms  # noqa: F401  they register their queries
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
