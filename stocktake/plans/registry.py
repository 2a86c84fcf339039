"""Registered queries by name, each with SQL for the same rows where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stocktake.sources.derived import Tables, with_tables

_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"query {name} twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = with_tables(sql)
        return f

    return keep


def _load() -> None:
    from . import content, evidence, mappings, objects, outcomes, prunes, reconciles, scalars, selections, sources, streams  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for k, f in sorted(_QUERIES.items())}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
