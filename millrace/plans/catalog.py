"""All queries of the engine, by name."""

from __future__ import annotations

from millrace.plans import collection_queries, notation_queries, page_queries, relational_queries, rule_queries, run_queries, scan_queries, stream_queries  # noqa: F401  they register themselves
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
