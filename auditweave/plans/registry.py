"""Named queries over the given tables and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from auditweave.plans.projection_sql import ESTATE
from auditweave.sources import projection
from auditweave.sources.estate import Estate


class Given:
    """The given tables of one folder, and the estate they project to."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._source = projection.Source(spark, folder)

    def base(self, table: str) -> DataFrame:
        return self._source(table)

    @cached_property
    def estate(self) -> Estate:
        return projection.stored_estate(self.spark, self.folder)


_QUERIES: dict[str, Callable[[Given], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, estate: bool = True):
    """Register ``fn(given) -> DataFrame``. ``sql`` may begin with more CTEs: ``, x AS (...)``."""

    def add(fn: Callable[[Given], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLE[name] = f"WITH RECURSIVE {ESTATE.strip()}\n{sql.strip()}" if estate else sql.strip()
        return fn

    return add


def _load() -> None:
    from auditweave.plans import (  # noqa: F401
        audit_queries,
        case_queries,
        claim_queries,
        detector_queries,
        evaluation_queries,
        graph_queries,
        lookup_queries,
        ranking_queries,
        statistics_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {name: (lambda spark, folder, fn=fn: fn(Given(spark, folder))) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
