"""All queries of the library and their SQL oracles, from the modules that define them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("matching", "comparison", "sectioned", "runs", "modelled", "studies", "details", "terms", "graphs", "linking", "corpora")


def query(name: str, sql: str | None = None):
    """Register a query and the SQL that gives the same rows."""

    def register(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return register


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
