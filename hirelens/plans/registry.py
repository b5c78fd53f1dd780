"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame``
and, where SQL can express it, the DuckDB oracle text."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.postings import PV_SQL

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, pv: bool = False):
    """Register a query; ``pv=True`` prefixes the oracle with the PV CTEs."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_pv(sql) if pv else sql
        return fn
    return deco


def with_pv(sql: str) -> str:
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {PV_SQL.strip()},\n{body[5:]}"
    return f"WITH {PV_SQL.strip()}\n{body}"
