"""Registered queries and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("reads", "joins", "aggregates", "indices", "windows", "sets", "merges", "texts", "clusters", "jobs", "sources", "streams", "more", "news", "stories", "imports", "tables", "narratives", "details", "materialized")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a query under its inventory id: a function of its input tables or views."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, t) for t in tables))
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def stored(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query that needs the session and the folder of the tables themselves."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    for m in MODULES:
        import_module(f"tidewire.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
