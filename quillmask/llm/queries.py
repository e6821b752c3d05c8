"""The queries of the ten operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmask.llm import query_chats, query_filters, query_fingerprints, query_near, query_pages, query_tokens

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (query_filters, query_tokens, query_chats, query_fingerprints, query_pages, query_near)

QUERIES: dict[str, Query] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
