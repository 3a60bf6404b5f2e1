"""All queries on the engine's own operators, with the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from strata.plans.tables import checkpoints

GROUPS = ("search", "hybrid", "records", "build", "evaluate", "provenance", "integrity")


def _registered() -> dict[str, tuple[Callable, str | None]]:
    out: dict[str, tuple[Callable, str | None]] = {}
    for group in GROUPS:
        out |= import_module(f"strata.plans.{group}").QUERIES
    return out


def _ready(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        checkpoints(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _ready(query) for name, (query, _) in _registered().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["rrf_fusion"](spark, sf_dir)
