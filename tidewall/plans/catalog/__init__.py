"""Named queries over the supplied tables, each with its DuckDB statement where SQL can state it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewall.plans.views import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the derived views by name."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add


MODULES = (
    "sources", "pii", "secrecy", "structured", "policy", "lifecycle", "audit", "integrity", "files",
    "threats", "network", "calendar", "streams", "extensions",
)


def load_all() -> None:
    for m in MODULES:
        importlib.import_module(f"tidewall.plans.catalog.{m}")
