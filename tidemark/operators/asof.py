"""Point-in-time joins: facts meet probes by the day on which they became known."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(probes: DataFrame, facts: DataFrame, by: list[str], at: str, known: str, tolerance: int | None = None) -> DataFrame:
    """probes with the columns of the latest fact of the same `by` whose `known` is not after `at`.

    One shuffle on `by`: facts and probes are one stream in order of time, and each probe takes the last fact before
    it. A fact overrides older ones even where its columns are null. `tolerance`: days after which it counts no more.
    """
    columns = [c for c in facts.columns if c not in by]
    fact = F.struct(*[F.col(c) for c in columns])
    left = probes.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("_fact"), F.struct(*probes.columns).alias("_probe"))
    right = facts.select(*by, F.col(known).alias("_at"), F.lit(0).alias("_side"), fact.alias("_fact"), F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"))
    w = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = left.unionByName(right).withColumn("_last", F.last("_fact", ignorenulls=True).over(w)).where("_side = 1")
    if tolerance is not None:
        met = met.withColumn("_last", F.when(F.datediff("_at", F.col(f"_last.{known}")) <= tolerance, F.col("_last")))
    return met.select("_probe.*", *[F.col(f"_last.{c}").alias(c) for c in columns])


def asof_joins(probes: DataFrame, facts: dict[str, tuple[DataFrame, str]], by: list[str], at: str) -> DataFrame:
    """probes with a struct column for each kind of fact (a table and its day of becoming known): the latest one not after `at`.

    All kinds and the probes are one stream, so that any number of kinds takes one shuffle (none where all lie dealt out
    by the first of `by`) and one sort. The rows stay in the order of `by` and `at`, for windows that follow.
    """
    kinds = {k: F.struct(*[F.col(c) for c in f.columns if c not in by]) for k, (f, _) in facts.items()}
    types = {k: f.select(kinds[k].alias("f")).schema["f"].dataType for k, (f, _) in facts.items()}
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rest = [x for x in probes.schema if x.name not in (*by, at)]
    stream = probes.select(*by, at, F.lit(1).alias("_side"), *[x.name for x in rest], *[none(k, t) for k, t in types.items()])
    for k, (f, known) in facts.items():
        row = f.select(*by, F.col(known).cast(probes.schema[at].dataType).alias(at), F.lit(0).alias("_side"), *[none(x.name, x.dataType) for x in rest], *[kinds[k].alias(k) if j == k else none(j, t) for j, t in types.items()])
        stream = stream.unionByName(row)
    w = Window.partitionBy(*by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    met = stream.select(*by, at, "_side", *[x.name for x in rest], *[F.last(k, ignorenulls=True).over(w).alias(k) for k in facts])
    return met.where("_side = 1").select(*probes.columns, *facts)


def nearest_join(rows: DataFrame, by: list[str], day: str, value: str, back: int = 365, within: int = 60) -> DataFrame:
    """rows with `earlier`: the value nearest to `back` days before, within so many days of it; of two, the earlier."""
    past = rows.select(*by, F.col(day).alias("_day"), F.col(value).alias("_value"))
    # the months that can hold such a day make it an equality join
    month = lambda d: F.months_between(F.trunc(d, "month"), F.lit("1970-01-01").cast("date")).cast("int")
    reach = F.sequence(month(F.date_sub(F.col(day), back + within)), month(F.date_sub(F.col(day), back - within)))
    keyed = rows.withColumn("_month", F.explode(reach))
    met = keyed.join(past.withColumn("_month", month(F.col("_day"))), [*by, "_month"], "left")
    off = F.abs(F.datediff(F.col(day), "_day") - back)
    best = F.min(F.when(off <= within, F.struct(off.alias("off"), F.col("_day").alias("day"), F.col("_value").alias("value"))))
    return met.groupBy(*rows.columns).agg(best.alias("_best")).select(*rows.columns, F.col("_best.value").alias("earlier"))


def shifted_join(rows: DataFrame, calendar: DataFrame, by: list[str], day: str, value: str, offset: int, name: str) -> DataFrame:
    """rows with the value of the day that is `offset` calendar days (rows of calendar: day, i) later."""
    indexed = rows.join(calendar.select(day, "i"), day)
    later = indexed.select(*by, (F.col("i") - offset).alias("i"), F.col(value).alias(name))
    return indexed.join(later, [*by, "i"], "left").drop("i")
