"""All queries by name, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.plans import catalogue, extended, models, nesting, profiling, structure

MODULES = (profiling, catalogue, nesting, models, structure, extended)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiling.QUERIES["agg1_column_profile"][0](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
