"""All queries of the subpackage, for the driver's entry module."""

from __future__ import annotations

import importlib
import importlib.util

MODULES = ["queries_groups", "queries_splits", "queries_vectors", "queries_tokens", "queries_leaks", "queries_encoding"]


def _gather(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        if importlib.util.find_spec(f"{__package__}.{name}"):
            found |= getattr(importlib.import_module(f"{__package__}.{name}"), what)
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
