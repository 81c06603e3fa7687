"""Named queries over the supplied tables, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from brindle.plans import advertisements, annotation, corpus, evaluation, evidence, exchange, labeling, lifecycle, location, streaming

MODULES = (corpus, lifecycle, evaluation, labeling, location, streaming, advertisements, annotation, evidence, exchange)
FLAGSHIP = "q_exact_dedup_survivor"
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
