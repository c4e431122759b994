"""Registered queries of the engine and their DuckDB oracles."""

from __future__ import annotations

from tidemark.plans import event_queries, source_queries  # noqa: F401  (they register their queries and oracles)
from tidemark.plans.oracles import ORACLE_SQL
from tidemark.plans.queries import QUERIES

FLAGSHIP = "flagship"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
