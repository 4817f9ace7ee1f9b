"""Queries of the archive by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from playloom.plans import archive_queries, ingest_queries, log_queries, profile_queries, rotation_queries

_MODULES = (archive_queries, log_queries, ingest_queries, profile_queries, rotation_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
