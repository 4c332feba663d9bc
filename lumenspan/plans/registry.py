"""All queries over the test tables, with their SQL."""

from __future__ import annotations

from . import etl_queries, interval_queries, signal_queries, source_queries, text_queries

MODULES = (etl_queries, interval_queries, text_queries, signal_queries, source_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
