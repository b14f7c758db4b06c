"""Registry of queries and their checking SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargolens.plans import facts

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (
    "text", "callables", "archives", "formats", "bundles", "metadata", "findings",
    "compliance", "reports", "streams", "scalars",
)
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``$table`` in the SQL stands for a table or a derived fact."""

    def register(function: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} is already registered")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, with its ``$table`` marks."""
    return _SQL[name]


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"cargolens.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: facts.for_oracle(sql) for name, sql in _SQL.items()}
