"""The registered queries of the library, each with DuckDB SQL for the same rows where SQL can say it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables, with_fixtures

MODULES = ["catalogue", "geometry", "pixels", "datasets", "landcover", "change", "evaluation", "experiments", "vectors", "registries", "streams"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of Tables under a name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = with_fixtures(sql)
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to 6 digits, without negative zero."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6) + F.lit(0.0)


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"gridloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship_changed_patches"](spark, sf_dir)
