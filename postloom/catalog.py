"""Every query of the library by name, with the SQL that says what it returns."""

from __future__ import annotations

from postloom.plans import export_queries, page_queries  # noqa: F401  (add their queries)
from postloom.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
