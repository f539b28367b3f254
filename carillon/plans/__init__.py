"""Query catalogue: operators bound to tables, each with its SQL where SQL can express it."""

from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES", "query"]

from . import association_queries, comparison_queries, evidence_queries, modal_queries, signal_queries  # noqa: E402, F401
