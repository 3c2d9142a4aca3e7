"""Registered queries over the driver's tables, each with its SQL twin."""

from __future__ import annotations

from importlib import import_module

FAMILIES = ("distill", "retrieval", "cognition", "graph", "narrative", "matching", "compiling", "sources", "people", "stores")


def _load():
    for name in FAMILIES:
        import_module(f"engram.plans.{name}")
    from engram.plans import registry

    return registry


def all_queries() -> dict:
    """Every query by name, functions of (spark, sf_dir)."""
    return _load().QUERIES


def all_oracles() -> dict[str, str]:
    """SQL for DuckDB of those that SQL can express."""
    return _load().ORACLE
