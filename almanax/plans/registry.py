"""Named queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple[str, ...] = ("grid", "scalars", "joins", "quality", "orbits", "listings", "files", "messages")


def _modules():
    return [importlib.import_module(f"almanax.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: q for m in _modules() for k, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _modules() for k, q in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["grid_system_epochs"](spark, sf_dir)
