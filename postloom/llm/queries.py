"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from postloom.llm import decontamination, lexical_search, license_scan, lm_scoring, near_dedup, ngram_join, packing, pii, quality_classifier, quality_rules, sharding, token_counts, whitening

MODULES = (packing, decontamination, lm_scoring, token_counts, pii, quality_rules, license_scan, sharding, near_dedup, quality_classifier, ngram_join, lexical_search, whitening)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
