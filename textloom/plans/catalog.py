"""All queries of the library proper, and the SQL that each must agree with."""

from __future__ import annotations

from . import corpus_queries, detail_queries, lexical_queries, rewrite_queries, search_queries, style_queries

PARTS = (style_queries, rewrite_queries, corpus_queries, search_queries, lexical_queries, detail_queries)

QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
