"""All queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from . import catalogues, factors, features, labs, portfolios, profiles, relational, samples, search, snapshot, streams, supplements, technicals  # noqa: F401
from .base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
