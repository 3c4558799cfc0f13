"""Market regimes: raw label, confirmation, exposure ladder, switches and episodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .windows import Series, debounced

#: (k, m): so many of the last m raw labels must agree to change state.
ENTER_BEAR, LEAVE_BEAR, OTHER = (2, 5), (10, 10), (5, 5)


def raw_regime(rows: DataFrame, by: str = "id", day: str = "d", value: str = "close", span: int = 120, slope: int = 20, deep: float = 0.93, weeks: int = 24, week_slope: int = 4) -> DataFrame:
    """rows with `raw`: bull, neutral, bear or bear_fast, by the long mean and its slope, with the completed weeks' agreement."""
    s, ws = Series(by, day), Series(by, "_week")
    weekly = rows.groupBy(by, F.trunc(day, "week").alias("_week")).agg(F.max_by(value, day).alias("_wc")).withColumn("_wma", ws.mean("_wc", weeks))
    weekly = weekly.withColumn("_w0", ws.lag("_wma", week_slope))
    label = F.when((F.col("_wc") > F.col("_wma")) & (F.col("_wma") > F.col("_w0")), "bull").when((F.col("_wc") < F.col("_wma")) & ~F.coalesce(F.col("_wma") > F.col("_w0"), F.lit(False)), "bear").otherwise("neutral")
    # a week is known from its Friday on: until then the week before counts
    weekly = weekly.select(by, "_week", label.alias("_now"), F.lag(label).over(ws.w).alias("_prev"))
    long = rows.withColumn("_ma", s.mean(value, span)).withColumn("_ma0", s.lag("_ma", slope)).withColumn("_week", F.trunc(day, "week"))
    met = long.join(weekly, [by, "_week"], "left").withColumn("_weekly", F.when(F.dayofweek(day).isin(6, 7, 1), F.col("_now")).otherwise(F.coalesce("_prev", F.lit("neutral"))))
    v = F.col(value)
    raw = F.when(v < F.col("_ma") * deep, "bear_fast").when((v > F.col("_ma")) & (F.col("_ma") > F.col("_ma0")), "bull").when((v < F.col("_ma")) & ~(F.col("_ma") > F.col("_ma0")), "bear").otherwise("neutral")
    clash = raw.isin("bull", "bear") & (F.col("_weekly") != "neutral") & (F.col("_weekly") != raw)
    known = F.col("_ma").isNotNull() & F.col("_ma0").isNotNull()
    return met.withColumn("raw", F.when(known & ~clash, raw).otherwise("neutral")).drop("_ma", "_ma0", "_week", "_now", "_prev", "_weekly")


def confirmed(raws: list[str]) -> list[str]:
    """The state after each raw label; starts neutral. A fast break is a bear at once."""
    state, out = "neutral", []
    for i, raw in enumerate(raws):
        want = "bear" if raw.startswith("bear") else raw
        if raw == "bear_fast":
            state = "bear"
        elif want != state:
            k, m = ENTER_BEAR if want == "bear" else LEAVE_BEAR if state == "bear" else OTHER
            last = raws[max(0, i - m + 1) : i + 1]
            if sum(("bear" if x.startswith("bear") else x) == want for x in last) >= k:
                state = want
        out.append(state)
    return out


def hysteresis(rows: DataFrame, by: str = "id", day: str = "d") -> DataFrame:
    """(by, day, raw, regime): the confirmed regime of each entity's series (one entity's days at a time)."""
    kinds = dict(rows.select(by, day, "raw").dtypes)

    def one(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(day)
        return f.assign(regime=confirmed(list(f["raw"])))

    schema = f"{by} {kinds[by]}, {day} {kinds[day]}, raw string, regime string"
    return rows.select(by, day, "raw").groupBy(by).applyInPandas(one, schema)


def exposure_ladder(rows: DataFrame, by: str = "id", day: str = "d", value: str = "close", spans: tuple[int, ...] = (50, 100, 200), up: int = 3, down: int = 3) -> DataFrame:
    """rows with above<k> (confirmed: above the mean of k) and exposure, the share of them that hold; null until all means are known."""
    s = Series(by, day)
    out = rows.withColumns({f"_ma{k}": s.mean(value, k) for k in spans}).where(" AND ".join(f"_ma{k} IS NOT NULL" for k in spans))
    out = out.withColumns({f"_above{k}": F.col(value) > F.col(f"_ma{k}") for k in spans})
    for k in spans:
        out = debounced(out, [by], day, f"_above{k}", up, down, f"above{k}")
    held = sum((F.col(f"above{k}").cast("int") for k in spans[1:]), F.col(f"above{spans[0]}").cast("int"))
    return out.withColumn("exposure", held / float(len(spans))).drop(*[f"_ma{k}" for k in spans], *[f"_above{k}" for k in spans])


def whipsaws(rows: DataFrame, by: str, day: str, state: str, within: int = 10) -> DataFrame:
    """(by, day, state): changes of state that are undone within so many days."""
    w = Window.partitionBy(by).orderBy(day)
    switches = rows.withColumn("_before", F.lag(state).over(w)).where(F.col("_before") != F.col(state))
    return switches.withColumn("_next", F.lead(day).over(w)).withColumn("_after", F.lead(state).over(w)).where((F.datediff("_next", day) <= within) & (F.col("_after") == F.col("_before"))).select(by, day, state)


def episodes(months: DataFrame, by: str, index: str, gap: int = 2) -> DataFrame:
    """(by, episode, first, last, n): runs of month numbers that are at most `gap` apart."""
    w = Window.partitionBy(by).orderBy(index)
    new = F.when(F.coalesce(F.col(index) - F.lag(index).over(w) > gap, F.lit(True)), 1).otherwise(0)
    marked = months.withColumn("_new", new).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(by, "episode").agg(F.min(index).alias("first"), F.max(index).alias("last"), F.count("*").alias("n"))
