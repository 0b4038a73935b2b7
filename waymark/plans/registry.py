"""Every registered query of the location and event operators, and its DuckDB SQL."""

from __future__ import annotations

from . import cost_queries, feed_queries, list_queries, record_queries, scalar_queries, state_queries, table_queries, trajectory_queries

_ALL = [e for m in (cost_queries, trajectory_queries, table_queries, scalar_queries, list_queries, feed_queries, state_queries, record_queries) for e in m.ENTRIES]
QUERIES = {name: fn for name, fn, _ in _ALL}
ORACLES = {name: sql for name, _, sql in _ALL if sql is not None}
