"""Queries by name, and their DuckDB SQL."""

from __future__ import annotations

from . import lake_queries, limit_queries, model_queries, source_queries, stats_queries

FLAGSHIP = "topk_joinable_columns"
QUERIES = {**lake_queries.QUERIES, **stats_queries.QUERIES, **source_queries.QUERIES, **limit_queries.QUERIES, **model_queries.QUERIES}
ORACLE = {**lake_queries.ORACLE, **stats_queries.ORACLE, **source_queries.ORACLE, **limit_queries.ORACLE, **model_queries.ORACLE}
