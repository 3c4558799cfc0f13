"""Cross-sectional ranks and the four bucketings; they differ at the edges and are not interchangeable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct_rank(value: str, *by: str) -> Column:
    """Average rank over the number of values, times 100, within `by`; null for null."""
    v = F.col(value)
    w = Window.partitionBy(*by)
    nulls = F.count(F.when(v.isNull(), 1)).over(w)
    average = F.rank().over(w.orderBy(v.asc_nulls_first())) - nulls + (F.count(v).over(Window.partitionBy(*by, value)) - 1) / 2.0
    return F.when(v.isNotNull(), average / F.count(v).over(w) * 100)


def average_rank(value: str, *by: str) -> Column:
    """Rank with ties averaged, from 1, within `by`; null for null."""
    v = F.col(value)
    w = Window.partitionBy(*by)
    nulls = F.count(F.when(v.isNull(), 1)).over(w)
    return F.when(v.isNotNull(), F.rank().over(w.orderBy(v.asc_nulls_first())) - nulls + (F.count(v).over(Window.partitionBy(*by, value)) - 1) / 2.0)


def grouped_pct_rank(value: str, day: str, group: str, least: int = 5) -> Column:
    """Rank within the day's group; within the day where the group has fewer values than `least`."""
    return F.when(F.count(value).over(Window.partitionBy(day, group)) >= least, pct_rank(value, day, group)).otherwise(pct_rank(value, day))


def bucket_first(r: Column, n: Column, q: int) -> Column:
    """Equal-width cuts of the rank (r from 1, ties by order) between its least and its largest."""
    return F.when(n > 1, F.greatest(F.lit(1), F.ceil((r - 1) * q / F.nullif(n - 1, F.lit(0))))).otherwise(1).cast("int")


def bucket_share(r: Column, n: Column, q: int) -> Column:
    """ceil(r / n q), clamped to 1..q."""
    return F.least(F.lit(q), F.greatest(F.lit(1), F.ceil(r / n * q))).cast("int")


def bucket_slice(r: Column, n: Column, q: int) -> Column:
    """The slice [floor(b n / q), floor((b + 1) n / q)) that holds r - 1; b from 0."""
    cuts = [F.when(r - 1 >= F.floor(n * (b + 1) / q), 1).otherwise(0) for b in range(q - 1)]
    return sum(cuts[1:], cuts[0]).cast("int")


def _by_range(rows: DataFrame, value: str, width: float) -> tuple[DataFrame, DataFrame]:
    """(rows with the range `_b` of the value, ranges with `_before` and `_in`: the rows of lower ranges and of their own)."""
    binned = rows.withColumn("_b", F.floor(F.col(value) / width))
    counts = binned.groupBy("_b").agg(F.count("*").alias("_in"))
    # one row for each range of the values' span
    before = F.coalesce(F.sum("_in").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return binned, counts.select("_b", "_in", before.alias("_before"))


def pooled_rank(rows: DataFrame, value: str, width: float, *ties: str) -> DataFrame:
    """rows (value not null) with `_r`, the rank from 1 over all rows, and `_n`, their number; a task ranks one range of `width`."""
    binned, ranges = _by_range(rows, value, width)
    ranges = ranges.withColumn("_n", F.sum("_in").over(Window.partitionBy()))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy(value, *ties)) + F.col("_before")
    return binned.join(F.broadcast(ranges), "_b").withColumn("_r", rank).drop("_b", "_in", "_before")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float], width: float) -> DataFrame:
    """One row with the exact quantile of each share, linear between values: only the ranges that hold the ranks are sorted."""
    binned, ranges = _by_range(rows.where(F.col(value).isNotNull()).select(value), value, width)
    ranges = ranges.withColumn("_n", F.sum("_in").over(Window.partitionBy()))
    at = {k: q * (F.col("_n") - 1) for k, q in shares.items()}
    ranks = [f(x) for x in at.values() for f in (F.floor, F.ceil)]
    held = reduce(lambda a, b: a | b, [(r >= F.col("_before")) & (r < F.col("_before") + F.col("_in")) for r in ranks])
    near = binned.join(F.broadcast(ranges.where(held)), "_b")
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(value)) - 1 + F.col("_before"))
    pick = lambda r: F.max(F.when(F.col("_r") == r, F.col(value)))
    out = near.agg(F.max("_n").alias("_n"), *[pick(f(x)).alias(f"_{k}{i}") for k, x in at.items() for i, f in enumerate((F.floor, F.ceil))])
    return out.select(*[(F.col(f"_{k}0") + (F.col(f"_{k}1") - F.col(f"_{k}0")) * (x - F.floor(x))).alias(k) for k, x in at.items()])


def in_tail(r: Column, n: Column, q: float) -> Column:
    """-1 for the floor(n q) lowest, 1 for as many highest, else 0."""
    k = F.floor(n * q)
    return F.when(r <= k, -1).when(r > n - k, 1).otherwise(0)
