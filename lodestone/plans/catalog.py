"""The queries of the core and their SQL, gathered from the modules that define them."""

from __future__ import annotations

import importlib

MODULES = ("lodestone.plans.retrieval", "lodestone.plans.measure", "lodestone.plans.parts", "lodestone.plans.corpus", "lodestone.plans.files", "lodestone.plans.reports", "lodestone.plans.entries", "lodestone.plans.units")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in importlib.import_module(m).SQL.items()}
