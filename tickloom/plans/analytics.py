"""All queries of the signal engine, with their SQL."""

from __future__ import annotations

from tickloom.plans import indicator_queries, more_queries, oracle, position_queries, signal_queries, store_queries, stream_queries

__all__ = ["ORACLE_SQL", "QUERIES", "more_queries", "position_queries", "signal_queries", "store_queries", "stream_queries"]

QUERIES = dict(indicator_queries.QUERIES)
ORACLE_SQL = oracle.SQL
