"""One declaration per query: a Spark callable and, where SQL can express it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans.dialect import Node

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name`` together with its oracle."""

    def keep(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is declared twice")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn

    return keep


def declare(name: str, node: Node, oracle: bool = True) -> None:
    """Register an operator tree: Spark runs it, and DuckDB the same tree in its own dialect."""
    query(name, node.duck() if oracle else None)(lambda spark, sf_dir: node.spark(spark, sf_dir))


def _load() -> None:
    from lodestar.plans import catalog  # noqa: F401  (declares every query on import)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
