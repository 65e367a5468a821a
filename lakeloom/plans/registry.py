"""All registered queries of the relational part, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..catalog import sql

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    """Registers a query under its function's name; oracle is the same in DuckDB's SQL, None where SQL can't tell."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if oracle is not None:
            _ORACLE[key] = oracle
        return f

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Registers SQL text; where Spark's and DuckDB's dialects agree it is its own oracle."""
    _QUERIES[name] = lambda spark, sf_dir: sql(spark, sf_dir, text)
    _ORACLE[name] = oracle or text


def _load() -> None:
    from . import ch, files, joins, relational, scalar, state, transactions, writes  # noqa: F401  (they register themselves)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
