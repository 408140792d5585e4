"""All registered queries."""

from . import call_queries, csr_queries, interval_queries, model_queries, read_queries, stat_queries, variant_queries  # noqa: F401  (they register themselves)
from .registry import ENTRIES, oracle_sql, queries, run

__all__ = ["ENTRIES", "oracle_sql", "queries", "run"]
