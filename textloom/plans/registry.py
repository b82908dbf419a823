"""All queries of the core, by name: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from textloom.plans import core, core_more, corpus_queries, geometry, more_metrics, p1_copies, p4_nested, prose_metrics, structure  # noqa: F401 (the others register their queries with core)

QUERIES = {"p1_found": p1_copies.found} | p4_nested.QUERIES | core.QUERIES
ORACLE_SQL = {"p1_found": p1_copies.FOUND_SQL} | p4_nested.ORACLE_SQL | core.ORACLE_SQL
