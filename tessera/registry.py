"""Every reference query by name: its DataFrame callable and, where SQL can state it, the oracle."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "q1_pipeline_baseline"
MODULES = ("telemetry", "reports", "measures", "relations", "rollups", "scores", "scalars", "curation", "directing", "metadata", "streams")


def _all():
    return [import_module(f"tessera.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for module in _all() for name, fn in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _all() for name, sql in module.ORACLES.items()}
