"""Every registered query of the library, by name, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.plans import basics, keeping, layers, layouts, marts, python, revenue, sources, stream_audits, stream_jobs, streams, tables

MODULES = [revenue, marts, tables, streams, stream_jobs, stream_audits, layers, basics, layouts, sources, python, keeping]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLE_SQL.items()}
