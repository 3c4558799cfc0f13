"""How queries are registered: a function of the panels, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.functions.numeric import rounded as r4
from tidemark.functions.numeric import rounded_sql as R4
from tidemark.sources.panels import Panels, with_panels

__all__ = ["ORACLE", "QUERIES", "R4", "Panels", "dealt", "query", "r4"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def dealt(p):
    """The panels from one shuffle; panels of another kind as they are."""
    return getattr(p, "dealt", p)


def query(name: str, oracle: str | None = None) -> Callable:
    def add(fn: Callable[[Panels], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(Panels(spark, sf_dir))
        if oracle:
            ORACLE[name] = with_panels(oracle)
        return fn

    return add
