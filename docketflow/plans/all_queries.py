"""All registered queries of the package."""

from __future__ import annotations

from importlib import import_module

from docketflow.plans.catalog import Query

MODULES = ["review_queries", "intake_queries", "deck_queries", "near_miss_queries", "plug_queries", "stream_queries"]


def all_queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(import_module(f"docketflow.plans.{name}").CATALOG.queries)
    return found


def all_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(import_module(f"docketflow.plans.{name}").CATALOG.sql)
    return found
