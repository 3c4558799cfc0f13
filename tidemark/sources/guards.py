"""Guards that fail loudly: rows are written beside their place, measured while they are, and published only if every guard holds."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: Days after which a day, and a known revenue month, count as stale; greatest share of nulls in the value leg, least coverage of every leg, in percent: fixed values.
STALE_DAYS, REVENUE_STALE_DAYS, VALUE_NULLS, COVERAGE = 5, 45, 20.0, 95.0


class GuardError(ValueError):
    """Rows that a guard refused; nothing was published."""

    def __init__(self, broken: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in broken.items()))
        self.broken = broken


@dataclass(frozen=True)
class Guard:
    """A name, what is measured, and a message if the measures break it (None if not); a guard that only warns stops nothing."""

    name: str
    measures: dict[str, Column]
    broken: Callable[[dict], str | None]
    fatal: bool = True


def fresh(day: str, expected: date) -> Guard:
    """The newest day is the one that is expected."""
    return Guard("fresh", {"fresh_day": F.max(day)}, lambda m: None if m["fresh_day"] == expected else f"newest day {m['fresh_day']}, expected {expected}")


def not_stale(day: str, today: date, most: int = STALE_DAYS, fatal: bool = False) -> Guard:
    def broken(m: dict) -> str | None:
        return None if m["stale_day"] and (today - m["stale_day"]).days <= most else f"newest day {m['stale_day']}, more than {most} days before {today}"

    return Guard("stale", {"stale_day": F.max(day)}, broken, fatal)


def enough(least: int) -> Guard:
    return Guard("enough", {"enough_rows": F.count("*")}, lambda m: None if m["enough_rows"] >= least else f"{m['enough_rows']} rows, fewer than {least}")


def leg_present(leg: str, nulls: float = VALUE_NULLS) -> Guard:
    """A leg isn't missing as a whole, and at most a share of it is, in percent."""

    def broken(m: dict) -> str | None:
        n, known = m["leg_rows"], m["leg_known"]
        if not known:
            return f"no {leg} at all"
        share = 100.0 * (n - known) / n
        return f"{share:.1f} % of {leg} missing, more than {nulls}" if share > nulls else None

    return Guard("leg", {"leg_rows": F.count("*"), "leg_known": F.count(leg)}, broken)


def legs_covered(legs: list[str], least: float = COVERAGE) -> Guard:
    """Every leg covers its least share of the rows, so that a mean over what is there doesn't go on with fewer legs."""

    def broken(m: dict) -> str | None:
        weak = {leg: 100.0 * m[f"covered_{leg}"] / m["covered_rows"] if m["covered_rows"] else 0.0 for leg in legs}
        return ", ".join(f"{leg} covers {c:.1f} %" for leg, c in weak.items() if c < least) or None

    return Guard("legs", {"covered_rows": F.count("*"), **{f"covered_{leg}": F.count(leg) for leg in legs}}, broken)


def complete(column: str, most: float = 20.0) -> Guard:
    """No more than a share of the rows' column is empty (null or 0), as on a day that was only begun."""
    empty = F.count_if(F.col(column).isNull() | (F.col(column) == 0))
    return Guard("complete", {"complete_rows": F.count("*"), "complete_empty": empty}, lambda m: None if 100.0 * m["complete_empty"] <= most * m["complete_rows"] else f"{m['complete_empty']} of {m['complete_rows']} rows have no {column}")


def published(rows: DataFrame, path: str, guards: list[Guard]) -> dict[str, str]:
    """Writes rows to path, in place of what is there, if every fatal guard holds; the messages of the guards that only warn.

    The measures are taken while the rows are written, in the same pass. Rows that are refused leave path as it was.
    """
    spark = rows.sparkSession
    seen = Observation(f"guards-{uuid.uuid4().hex}")
    measures = [c.alias(name) for g in guards for name, c in g.measures.items()]
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        rows.observe(seen, F.count("*").alias("_rows"), *measures).write.parquet(staged)
        found = [(g, message) for g in guards if (message := g.broken(seen.get))]
        if refused := {g.name: message for g, message in found if g.fatal}:
            raise GuardError(refused)
        files.delete(hadoop(path), True)
        if not files.rename(hadoop(staged), hadoop(path)):
            raise OSError(f"could not move {staged} to {path}")
    finally:
        files.delete(hadoop(staged), True)
    return {g.name: message for g, message in found}
