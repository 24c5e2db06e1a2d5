"""The registry: named queries over the test tables, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ("hierarchies", "texts", "terms", "search", "layouts")


def registry() -> tuple[dict, dict]:
    queries: dict = {}
    oracles: dict = {}
    for name in MODULES:
        module = import_module(f"vellumspark.plans.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
