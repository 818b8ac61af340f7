"""Registered queries over the tables, each with the SQL it must agree with where SQL can express it."""

from __future__ import annotations

from sparkloom.plans import analytics_queries, corpus_queries, stream_queries, trajectory_queries

_PARTS = (corpus_queries, trajectory_queries, analytics_queries, stream_queries)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL: dict[str, str] = {k: s for p in _PARTS for k, s in p.SQL.items()}
