"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracles[f.__name__] = sql
        return f

    return add


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["invoice_mentions"](spark, sf_dir)


def queries() -> dict[str, Query]:
    from doclens.plans import queries as _  # noqa: F401  fills the registry

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    from doclens.plans import queries as _  # noqa: F401

    return dict(_oracles)
