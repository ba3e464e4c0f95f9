"""Registry of named queries: Spark plan + DuckDB oracle SQL.

A registered query takes a :class:`Domain` (lazy domain tables over one
scale-factor directory) and returns a DataFrame.  The oracle, when given, is
plain SQL over the driver views, prefixed with the domain CTEs it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.domain import Domain
from .oracle_domain import with_domain

QueryFn = Callable[[Domain], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}
_BODY: dict[str, str] = {}


def query(key: str, oracle: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key!r}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = with_domain(oracle)
            _BODY[key] = oracle.strip()
        return fn
    return deco


def sql_of(key: str) -> str:
    """The oracle of a registered query without its domain tables, to build another on."""
    return _BODY[key]


def load_all() -> None:
    """Import every module that registers queries."""
    from . import (  # noqa: F401
        q_changes, q_filters, q_joins, q_nested, q_aggregates, q_windows, q_setops, q_quality,
        q_settlement, q_streaming, q_scalars,
    )


def as_callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()

    def bind(fn: QueryFn) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: fn(Domain(spark, sf_dir))

    return {k: bind(fn) for k, fn in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
