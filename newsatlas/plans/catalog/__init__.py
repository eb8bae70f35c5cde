"""Registered queries: each key has a Spark job and, where SQL can say it, the same result in SQL."""

from newsatlas.plans.catalog import browse, functions, ingest, rows, search, semantic, sources, summaries  # noqa: F401
from newsatlas.plans.catalog.registry import oracle_sql, queries  # noqa: F401
