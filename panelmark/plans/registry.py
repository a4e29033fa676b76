"""All registered queries with the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

SECTIONS = ["read", "intake", "derived", "forecasts", "texts", "streams", "stored"]

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return keep


def oracle(name: str) -> str:
    """The SQL of a query that was registered before, for another way to the same rows."""
    return _SQL[name]


def _load() -> None:
    for section in SECTIONS:
        import_module(f"panelmark.plans.{section}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
