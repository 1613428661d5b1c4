"""The registered queries and their SQL."""

from __future__ import annotations

from . import flow_queries, graph_queries, ingest_queries, rank_queries, search_queries, stats_queries
from .base import QUERIES, SQL, Query

MODULES = (search_queries, graph_queries, ingest_queries, stats_queries, rank_queries, flow_queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
