"""Queries over the given tables, one or more per operator of the inventory."""

from __future__ import annotations

from importlib import import_module

MODULES = ["source_queries", "column_queries", "relational_queries", "planning_queries", "model_queries"]


def load() -> tuple[dict, dict]:
    """(queries, checking SQL) by name."""
    for name in MODULES:
        import_module(f"runledger.catalog.{name}")
    registry = import_module("runledger.catalog.registry")
    return dict(registry.QUERIES), dict(registry.ORACLES)
