"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("preparation", "sampling", "evaluation", "texts", "variants", "files", "measures", "cases", "extension")


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, folder) under its name, with the SQL that must give the same rows."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"codeloom.plans.{name}")


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict:
    _load()
    return dict(_SQL)
