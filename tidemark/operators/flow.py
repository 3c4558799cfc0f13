"""Flow, ownership and fundamental features of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import ratio

from .windows import Series

S = Series()
HORIZONS = (1, 3, 5, 10, 20)


def streaks(rows: DataFrame, net: str, by: str = "id", day: str = "d") -> DataFrame:
    """rows with buy_days and sell_days: the run of days so far on which net is above (below) zero."""
    w = Window.partitionBy(by).orderBy(day)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    i = F.row_number().over(w)
    rows = rows.withColumn("_i", i)
    since = lambda stops: F.col("_i") - F.coalesce(F.max(F.when(stops, F.col("_i"))).over(past), F.lit(0))
    return rows.withColumns({"buy_days": since(F.col(net) <= 0), "sell_days": since(F.col(net) >= 0)}).drop("_i")


def net_over(rows: DataFrame, net: str, n: int, by: str = "id", day: str = "d") -> DataFrame:
    """(by, net, gross) over the last n days of each entity."""
    last = rows.withColumn("_k", F.dense_rank().over(Window.partitionBy(by).orderBy(F.desc(day)))).where(F.col("_k") <= n)
    return last.groupBy(by).agg(F.sum(net).alias("net"), F.sum(F.abs(net)).alias("gross"))


def horizon_ratios(net: str, volume: str = "volume") -> Column:
    """Map from each horizon to net over volume of its last days."""
    at = lambda k: ratio(F.sum(net).over(S.last(k)), F.sum(volume).over(S.last(k)))
    return F.map_from_arrays(F.array(*map(F.lit, HORIZONS)), F.array(*[at(k) for k in HORIZONS]))


def flow_state(long: Column, short: Column) -> Column:
    """One of four by the signs of the long and the short net flow; null where either is zero."""
    side = lambda v: F.when(v > 0, "in").when(v < 0, "out")
    return F.concat(side(long), F.lit("_"), side(short))


def revenue_momentum(months: DataFrame) -> DataFrame:
    """id, m, revenue, yoy, mom, ytd_yoy, accel, streak, smooth, ttm of monthly revenue; a year ago is the same month, not 12 rows."""
    w = Window.partitionBy("id").orderBy("m")
    year = Window.partitionBy("id", F.year("m")).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    rows = months.select("id", "m", "revenue").withColumn("ytd", F.sum("revenue").over(year))
    # a year ago is a frame of one month, so that the months stay where they are
    rows = rows.withColumn("_n", F.year("m") * 12 + F.month("m"))
    ago = lambda c: F.when(F.col("id").isNotNull() & F.col("m").isNotNull(), F.first(c).over(Window.partitionBy("id").orderBy("_n").rangeBetween(-12, -12)))
    rows = rows.withColumns({"_r": ago("revenue"), "_y": ago("ytd")}).withColumns({"yoy": ratio("revenue", "_r") - 1, "ytd_yoy": ratio("ytd", "_y") - 1, "mom": ratio(F.col("revenue"), F.lag("revenue").over(w)) - 1})
    last3, prev3 = F.avg("yoy").over(w.rowsBetween(-2, 0)), F.avg("yoy").over(w.rowsBetween(-5, -3))
    full = lambda frame, n, v: F.when(F.count("yoy").over(frame) == n, v)
    rows = rows.withColumn("accel", full(w.rowsBetween(-2, 0), 3, last3) - full(w.rowsBetween(-5, -3), 3, prev3))
    rows = rows.withColumns({"smooth": F.avg("revenue").over(w.rowsBetween(-2, 0)), "ttm": F.when(F.count("*").over(w.rowsBetween(-11, 0)) == 12, F.sum("revenue").over(w.rowsBetween(-11, 0)))})
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_i", F.row_number().over(w))
    return rows.withColumn("streak", F.col("_i") - F.coalesce(F.max(F.when(~F.coalesce(F.col("yoy") > 0, F.lit(False)), F.col("_i"))).over(past), F.lit(0))).drop("_i", "_n", "_r", "_y", "ytd")


def with_fallbacks(rows: DataFrame, neutral: dict[str, float]) -> DataFrame:
    """rows with nulls of the named columns at neutral values, `missing` (their names) and `confidence` (100 less 8 for each)."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in neutral]))
    out = rows.withColumn("missing", missing).withColumn("confidence", F.greatest(F.lit(0.0), 100.0 - F.size("missing") * 8))
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in neutral.items()})
