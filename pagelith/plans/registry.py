"""Query name -> (spark, sf_dir) callable, and its SQL for the second engine."""

from __future__ import annotations

from pagelith.plans import bounds_queries, continuation_queries, document_queries, preparation_queries, table_queries, text_queries

_ALL = (document_queries, table_queries, text_queries, preparation_queries, continuation_queries, bounds_queries)
QUERIES: dict = {name: f for module in _ALL for name, f in module.QUERIES.items()}
ORACLES: dict = {name: sql for module in _ALL for name, sql in module.ORACLES.items()}
