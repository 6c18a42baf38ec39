"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries when they are imported.
MODULES = ("pages", "documents", "records", "versions", "coverage", "catalog", "streams")
FOUND: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name, with the same query in SQL."""

    def keep(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load() -> None:
    for name in MODULES:
        import_module(f"strataloom.plans.{name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {k: s for k, (_, s) in FOUND.items() if s}
