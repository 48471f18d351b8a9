"""Every registered query of the signal engine and its SQL."""

from __future__ import annotations

from tideline.plans import cluster_queries, function_queries, report_queries, signal_queries, structure_queries, table_queries  # noqa: F401  they register their queries
from tideline.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
