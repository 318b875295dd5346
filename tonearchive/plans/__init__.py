"""Registered queries: importing this package registers all of them."""

from . import block_queries, rule_queries, signal_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "block_queries", "rule_queries", "signal_queries"]
