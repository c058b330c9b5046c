"""All queries of the library, by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plyforge.sources.positions import oracle as with_catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: make ``fn(spark, sf_dir)`` the query ``name``."""

    def put(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return put


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {name: with_catalogue(sql) for name, sql in ORACLES.items()}
