"""Scalar helpers that give the same double in any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    """x to a number of places, halves up, by exact steps that any engine repeats."""
    f = float(10**places)
    return F.floor(x * F.lit(f) + F.lit(0.5)).cast("double") / F.lit(f)


def rounded_sql(x: str, places: int = 4) -> str:
    """The DuckDB text of `rounded`."""
    f = 10**places
    return f"FLOOR(({x}) * {f}::DOUBLE + 0.5::DOUBLE)::BIGINT::DOUBLE / {f}::DOUBLE"


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b as double; null where b is 0 or null."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def scaled(v: Column, low: float, high: float) -> Column:
    """0 to 100 linearly from low to high (low may be the larger), clamped outside."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (v - low) / (high - low) * 100))


def mean_of_present(*parts: Column) -> Column:
    """Mean of the parts that are not null."""
    n = sum(F.when(p.isNotNull(), 1).otherwise(0) for p in parts)
    return sum(F.coalesce(p.cast("double"), F.lit(0.0)) for p in parts) / F.nullif(n.cast("double"), F.lit(0.0))


def weighted_mean_of_present(parts: list[tuple[Column, float]]) -> Column:
    """Mean of the parts that are not null, by weights renormalised to those."""
    w = sum(F.when(p.isNotNull(), F.lit(x)).otherwise(F.lit(0.0)) for p, x in parts)
    return sum(F.coalesce(p.cast("double"), F.lit(0.0)) * x for p, x in parts) / F.nullif(w, F.lit(0.0))


def folded(v: Column, cap: float) -> Column:
    """v up to the cap, and mirrored at it beyond."""
    return F.when(v <= cap, v).otherwise(2 * cap - v)


def half_even(x: Column, places: int = 0) -> Column:
    """Rounded as Python rounds."""
    return F.bround(x, places)
