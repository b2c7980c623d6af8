"""Registered queries over the given tables, each with its check SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

from docweave.catalog.registry import QUERIES, SQL, Query

MODULES = ("chunk_queries", "text_queries", "extraction_queries", "retrieval_queries", "graph_queries", "run_queries")


def load() -> dict[str, Query]:
    for name in MODULES:
        import_module(f"docweave.catalog.{name}")
    return QUERIES


def check_sql() -> dict[str, str]:
    load()
    return SQL
