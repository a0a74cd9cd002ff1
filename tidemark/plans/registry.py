"""All queries on the reference's operators: name -> (callable, oracle SQL or None), gathered from the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("stats", "series", "calendar", "text", "geo", "io", "coding", "positions")


def _all() -> dict:
    found: dict = {}
    for m in MODULES:
        for name, pair in importlib.import_module(f"tidemark.plans.{m}").QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} is registered twice")
            found[name] = pair
    return found


def queries() -> dict:
    return {name: f for name, (f, _) in _all().items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in _all().items() if sql}
