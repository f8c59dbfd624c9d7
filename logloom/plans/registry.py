"""The named queries over the driver's tables, each with the SQL that an oracle can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its name, with its oracle if it has one."""

    def made(f):
        add(f.__name__, f, sql)
        return f

    return made


def add(name: str, f: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Register a query that is made, not written."""
    _QUERIES[name] = f
    if sql is not None:
        _SQL[name] = sql


def _load() -> None:
    from . import analysis, calls, corpora, logs  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
