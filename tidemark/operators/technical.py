"""Technical indicators as whole series: each adds columns to bars (id, d, t, open, high, low, close, volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import asof_joins
from .windows import Series

S = Series()


def _div(a, b):
    return a / F.nullif(b, F.lit(0.0))


def moving_averages(bars: DataFrame, *spans: int) -> DataFrame:
    """ma<k>: mean of the last k closes, of fewer at the start."""
    return bars.withColumns({f"ma{k}": S.mean("close", k, 1) for k in spans})


def weekly_average(bars: DataFrame, weeks: int = 20) -> DataFrame:
    """id, week (Monday), close (the week's last, carried over empty weeks), weekly_ma of up to so many weeks."""
    last = bars.groupBy("id", F.trunc("d", "week").alias("week")).agg(F.max_by("close", "d").alias("close"))
    s = Series("id", "week")
    last = last.withColumn("_until", F.coalesce(F.date_sub(s.lead("week"), 7), F.col("week")))
    whole = last.select("id", "close", F.explode(F.sequence("week", "_until", F.expr("INTERVAL 7 DAYS"))).alias("week")).withColumn("close", s.filled("close"))
    return whole.withColumn("weekly_ma", s.mean("close", weeks, 1))


def weekly_past(bars: DataFrame, weeks: int = 20) -> DataFrame:
    """id, week, sum and n of the closes of up to so many weeks less one before each week."""
    before = Series("id", "week").w.rowsBetween(1 - weeks, -1)
    return weekly_average(bars, weeks).select("id", "week", F.coalesce(F.sum("close").over(before), F.lit(0.0)).alias("sum"), F.count("close").over(before).alias("n"))


def weekly_as_of(bars: DataFrame, weeks: int = 20) -> DataFrame:
    """weekly_ma: mean of the last weeks' closes as known on the day, whose own close stands for its week."""
    met = asof_joins(bars, {"_past": (weekly_past(bars, weeks), "week")}, ["id"], "d")
    return met.withColumn("weekly_ma", weekly_mean("_past")).drop("_past")


def weekly_mean(past: str) -> Column:
    """The mean of a day's close and its week's `weekly_past`."""
    return (F.col("close") + F.col(f"{past}.sum")) / (1 + F.col(f"{past}.n"))


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd, signal, cross (golden, death, none), macd_status; null status before the slow span is full."""
    i = (F.col("t") - 1).cast("double")
    rows = S.smoothed(bars, i, _fast=("close", fast), _slow=("close", slow)).withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    rows = S.smoothed(rows, i, signal=("macd", signal)).withColumns({"_m": S.lag("macd"), "_s": S.lag("signal"), "_mid": S.mean("close", 20)})
    up = (F.col("_m") <= F.col("_s")) & (F.col("macd") > F.col("signal"))
    down = (F.col("_m") >= F.col("_s")) & (F.col("macd") < F.col("signal"))
    status = (
        F.when(up & (F.col("macd") > 0), "bullish_strong")
        .when(up & (F.col("macd") < 0) & (F.col("macd") > F.col("_mid") * -0.2), "bullish_recovery")
        .when(down, "bearish")
        .when(F.col("macd") > F.col("signal"), "neutral")
        .otherwise("bearish")
    )
    cross = F.when(up, "golden").when(down, "death").otherwise("none")
    return rows.withColumns({"cross": cross, "macd_status": F.when(F.col("t") >= slow, status)}).drop("_m", "_s", "_mid")


def bollinger(bars: DataFrame, window: int = 20, width: float = 2.0) -> DataFrame:
    """upper, lower, bandwidth, percent_b, bb_status."""
    rows = bars.withColumns({"_ma": S.mean("close", window), "_sd": S.std("close", window)})
    rows = rows.withColumns({"upper": F.col("_ma") + F.col("_sd") * width, "lower": F.col("_ma") - F.col("_sd") * width})
    band = F.col("upper") - F.col("lower")
    rows = rows.withColumn("bandwidth", band / F.col("_ma")).withColumn("_usual", S.mean("bandwidth", 20))
    status = F.when(F.col("bandwidth") < F.col("_usual") * 0.8, "squeezing").otherwise("expanding")
    return rows.withColumns({"percent_b": F.when(band > 0, (F.col("close") - F.col("lower")) / band), "bb_status": status}).drop("_ma", "_sd", "_usual")


def rsi(bars: DataFrame, window: int = 14) -> DataFrame:
    """rsi from plain means of gains and losses; null without a loss."""
    step = F.col("close") - S.lag("close")
    rows = bars.withColumns({"_gain": F.greatest(step, F.lit(0.0)), "_loss": F.greatest(-step, F.lit(0.0))})
    rows = rows.withColumns({"_gain": F.when(step.isNotNull(), F.col("_gain")), "_loss": F.when(step.isNotNull(), F.col("_loss"))})
    return rows.withColumn("rsi", 100 - 100 / (1 + _div(S.mean("_gain", window), S.mean("_loss", window)))).drop("_gain", "_loss")


def kdj(bars: DataFrame, n: int = 9) -> DataFrame:
    """k, d_, j with plain means of n."""
    low, high = S.lowest("low", n, 1), S.highest("high", n, 1)
    rows = bars.withColumn("_rsv", _div(F.col("close") - low, high - low) * 100)
    rows = rows.withColumn("k", S.mean("_rsv", n, 1)).withColumn("d_", S.mean("k", n, 1))
    return rows.withColumn("j", 3 * F.col("k") - 2 * F.col("d_")).drop("_rsv")


def atr(bars: DataFrame, window: int = 14) -> DataFrame:
    """atr: mean of the true range."""
    before = S.lag("close")
    rows = bars.withColumn("_tr", F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))
    return rows.withColumn("atr", S.mean("_tr", window, 1)).drop("_tr")


def on_balance(bars: DataFrame) -> DataFrame:
    """volume_ratio, obv, obv_rising, obv_above_ma20 (null until 10 rows), divergence (price up on thin volume)."""
    up = F.signum(F.coalesce(F.col("close") - S.lag("close"), F.lit(0.0)))
    rows = bars.withColumn("volume_ratio", F.col("volume") / S.mean("volume", 20)).withColumn("_s", up * F.col("volume"))
    rows = rows.withColumn("obv", F.sum("_s").over(S.past))
    rising = F.col("close") > S.lag("close")
    rows = rows.withColumn("obv_rising", F.coalesce(F.col("obv") > S.lag("obv"), F.lit(False)))
    return rows.withColumns({"obv_above_ma20": F.col("obv") > S.mean("obv", 20, 10), "divergence": F.coalesce(rising & (F.col("volume_ratio") < 1), F.lit(False))}).drop("_s")


def ma_cross(bars: DataFrame, short: int = 20, long: int = 60) -> DataFrame:
    """ma_cross: golden_cross, death_cross or neutral."""
    rows = bars.withColumns({"_a": S.mean("close", short), "_b": S.mean("close", long)}).withColumns({"_a0": S.lag("_a"), "_b0": S.lag("_b")})
    status = F.when((F.col("_a0") <= F.col("_b0")) & (F.col("_a") > F.col("_b")), "golden_cross").when((F.col("_a0") >= F.col("_b0")) & (F.col("_a") < F.col("_b")), "death_cross").otherwise("neutral")
    return rows.withColumn("ma_cross", status).drop("_a", "_b", "_a0", "_b0")


def bias_and_spike(bars: DataFrame, window: int = 20) -> DataFrame:
    """bias: percent above the mean close; spike: volume over its mean."""
    ma = S.mean("close", window, 1)
    return bars.withColumns({"bias": (F.col("close") - ma) / ma * 100, "spike": F.col("volume") / S.mean("volume", window, 1)})


def momentum(bars: DataFrame, lookback: int, skip: int = 0, name: str = "mom") -> DataFrame:
    """Percent return over lookback rows that ended skip rows ago; 0 without enough history."""
    return bars.withColumn(name, F.coalesce((_div(S.lag("close", skip), S.lag("close", skip + lookback)) - 1) * 100, F.lit(0.0)))


def chase_band(bars: DataFrame, z: float = 3.0, horizon: int = 25, least: float = 15.0, most: float = 45.0, window: int = 90) -> DataFrame:
    """band: how far above cost a price may run, in percent, by its volatility."""
    rows = atr(bars.withColumn("_r", S.change("close")))
    sd = F.coalesce(S.std("_r", window, 3), F.lit(0.0)) * 100
    vol = F.greatest(sd, F.col("atr") / F.col("close") * 100)
    return rows.withColumn("band", F.least(F.greatest(vol * (z * float(horizon) ** 0.5), F.lit(least)), F.lit(most))).drop("_r")


def back_adjusted(prices: DataFrame, value: str = "close", low: float = 0.7, high: float = 1.5) -> DataFrame:
    """adjusted: prices before a jump outside low..high scaled by all later jumps."""
    jump = F.col(value) / S.lag(value)
    rows = prices.withColumn("_ln", F.when((jump < low) | (jump > high), F.ln(jump)).otherwise(0.0))
    later = S.w.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("adjusted", F.col(value) * F.exp(F.coalesce(F.sum("_ln").over(later), F.lit(0.0)))).drop("_ln")


def split_adjusted(prices: DataFrame, value: str = "close") -> DataFrame:
    """split_factor: product of the whole ratios of all splits (falls of more than half) still to come."""
    return split_logs(prices, value).withColumn("split_factor", F.bround(F.exp("split_log"))).drop("split_log")


def split_logs(prices: DataFrame, value: str = "close") -> DataFrame:
    """split_log: natural logarithm of that product, which may pass any integer over a long series."""
    jump = F.col(value) / S.lag(value)
    rows = prices.withColumn("_ln", F.when(jump < 0.5, F.ln(F.greatest(F.bround(1 / jump), F.lit(1.0)))).otherwise(0.0))
    later = S.w.rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn("split_log", F.coalesce(F.sum("_ln").over(later), F.lit(0.0))).drop("_ln")


def scale_guard(prices: DataFrame, value: str = "close") -> DataFrame:
    """stable: the value, replaced by the one before where it jumps out of scale and far off the median of 20."""
    before = S.lag(value)
    rows = prices.withColumns({"_before": before, "_median": F.percentile(value, 0.5).over(S.w.rowsBetween(-20, -1))})
    jump = F.col(value) / F.col("_before")
    odd = ((jump < 0.4) | (jump > 2.5)) & (F.abs(F.col(value) / F.col("_median") - 1) > 0.6)
    return rows.withColumn("stable", F.when(odd, F.col("_before")).otherwise(F.col(value))).drop("_before", "_median")


def volume_concentration(bars: DataFrame, window: int = 20) -> DataFrame:
    """concentration: percent of the window's volume on days of rising closes."""
    up = F.when(F.col("close") > S.lag("close"), F.col("volume")).otherwise(0)
    return bars.withColumn("_up", up).withColumn("concentration", S.total("_up", window, 1) / S.total("volume", window, 1) * 100).drop("_up")


def technical_panel(bars: DataFrame) -> DataFrame:
    """rsi14, bbp20, ma_gap60, vol60, high52 with full windows (vol60 from 40 rows, high52 from 120)."""
    rows = rsi(bars).withColumnRenamed("rsi", "rsi14")
    rows = bollinger(rows).withColumnRenamed("percent_b", "bbp20").drop("upper", "lower", "bandwidth", "bb_status")
    rows = rows.withColumn("_r", S.change("close"))
    return rows.withColumns({"ma_gap60": F.col("close") / S.mean("close", 60) - 1, "vol60": S.std("_r", 60, 40), "high52": F.col("close") / S.highest("close", 240, 120) * 100}).drop("_r")


def volume_profile(bars: DataFrame, window: int = 90, bins: int = 30, area: float = 0.7) -> DataFrame:
    """id, poc, val, vah of each id's last `window` bars: the fullest price bin, and the span of the bins, fullest
    first, that hold `area` of the volume. Of equally full bins the higher comes first; prices to cents, half even."""
    n = Window.partitionBy("id").orderBy(F.desc("d"))
    last = bars.withColumn("_n", F.row_number().over(n)).where(F.col("_n") <= window)
    by = Window.partitionBy("id")
    last = last.withColumns({"_lo": F.min("close").over(by), "_hi": F.max("close").over(by)}).where("_hi > _lo")
    width = (F.col("_hi") - F.col("_lo")) / bins
    binned = last.withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("close") - F.col("_lo")) / width).cast("int")))
    full = binned.groupBy("id", "_lo", "_hi", "bin").agg(F.sum("volume").alias("v"))
    order = by.orderBy(F.desc("v"), F.desc("bin"))
    ranked = full.withColumns({"_before": F.coalesce(F.sum("v").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("v").over(by), "_r": F.row_number().over(order)})
    taken = ranked.where(F.col("_before") < F.col("_all") * area)
    at = lambda b: F.bround(F.col("_lo") + (b + 0.5) * (F.col("_hi") - F.col("_lo")) / bins, 2)
    spans = taken.groupBy("id", "_lo", "_hi").agg(F.max(F.when(F.col("_r") == 1, F.col("bin"))).alias("p"), F.min("bin").alias("a"), F.max("bin").alias("b"))
    return spans.select("id", at(F.col("p")).alias("poc"), at(F.col("a")).alias("val"), at(F.col("b")).alias("vah"))
