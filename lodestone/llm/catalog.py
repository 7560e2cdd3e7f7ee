"""The queries of this package and their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ("quantiles", "neardup", "boilerplate", "split", "knn", "packing", "mixing", "lookalike")


def _each(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        if importlib.util.find_spec(f"lodestone.llm.{name}"):
            out |= getattr(importlib.import_module(f"lodestone.llm.{name}"), what)
    return out


def queries() -> dict:
    return _each("QUERIES")


def oracle_sql() -> dict:
    return _each("SQL")
