"""All queries by name: the Spark callable, the same query as SQL for DuckDB, and what it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    covers: str = ""


QUERIES: dict[str, Query] = {}


def _register() -> None:
    """The query modules use ``Query``, so they are read after it is defined."""
    from .plans import modules

    for module in modules():
        QUERIES.update(module.QUERIES)


_register()
