"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from brindle.llm import contracts, decontaminate, interpolation, language, media, ngram_join, packing, secrets, suffix_dedup, url_rules, window_dedup

MODULES = (interpolation, suffix_dedup, secrets, packing, media, decontaminate, language, url_rules, window_dedup, ngram_join, contracts)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
