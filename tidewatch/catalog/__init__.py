"""Every registered query, each with its SQL twin where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query and, where SQL can express it, its twin."""
    from tidewatch.catalog.sql import oracle

    def add(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def load() -> None:
    """Import every catalogue module once."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"tidewatch.catalog.{module}")


MODULES = [
    "trigger",
    "screen",
    "tables",
    "forward",
    "payloads",
    "ranking",
    "market",
    "board",
    "flow",
]
