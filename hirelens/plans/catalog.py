"""All registered queries: importing this module fills the registry."""

from __future__ import annotations

from . import (coverage_queries, data_queries, enrich_queries, io_queries, report_queries,  # noqa: F401
               rule_queries, subscription_queries, textmine_queries)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
