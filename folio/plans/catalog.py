"""All queries of the engine with their oracle SQL, gathered from the modules of this package."""

from __future__ import annotations

from folio.plans import search_queries, store_queries, text_queries

QUERIES = text_queries.QUERIES | store_queries.QUERIES | search_queries.QUERIES
ORACLES = text_queries.ORACLES | store_queries.ORACLES | search_queries.ORACLES
