"""Registered query plans: each composes canonical views and operators into a
``(spark, sf_dir) -> DataFrame`` callable, paired with an equivalent SQL text
that DuckDB runs over the same parquet tables (the correctness oracle)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from ..session import ship_code
            ship_code(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    from . import dashboard, collect, trends, text, search, alerting, health, quality, discovery, more, matching, monitoring  # noqa: F401
