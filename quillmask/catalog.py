"""The registered queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmask.plans import detection, more, records

MODULES = (detection, records, more)
FLAGSHIP = "d18_detect_patterns"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
