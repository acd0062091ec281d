"""The queries of the corpus operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from emberlake.llm import queries, audits

QUERIES = queries.QUERIES | audits.QUERIES
ORACLES = queries.ORACLES | audits.ORACLES
__all__ = ["ORACLES", "QUERIES"]
