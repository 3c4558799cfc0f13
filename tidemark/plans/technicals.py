"""Window and technical-indicator queries over the smoothed bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import grouped_pct_rank, pct_rank
from tidemark.operators import technical as T
from tidemark.operators.windows import Series, expanding_pct, latest_row

from .base import R4, query, r4

S = Series()
W = "WINDOW w AS (PARTITION BY id ORDER BY d)"
P = "PARTITION BY id ORDER BY d"


def shown(rows, *names, keep=()):
    """id, d, the kept columns as they are and the named ones rounded."""
    return rows.select("id", "d", *keep, *[r4(F.col(n)).alias(n) for n in names])


def roll(fn, v, k, least=None):
    frame = f"OVER ({P} ROWS {k - 1} PRECEDING)"
    return f"CASE WHEN COUNT({v}) {frame} >= {k if least is None else least} THEN {fn}({v}) {frame} END"


def avg_rank_sql(v, by):
    return f"CASE WHEN {v} IS NOT NULL THEN (RANK() OVER (PARTITION BY {by} ORDER BY {v} NULLS LAST) + (COUNT({v}) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE) / COUNT({v}) OVER (PARTITION BY {by}) * 100 END"


@query("ma5_ma20", f"SELECT id, d, {R4(roll('AVG', 'close', 5, 1))} AS ma5, {R4(roll('AVG', 'close', 20, 1))} AS ma20 FROM sbars")
def ma5_ma20(p):
    return shown(T.moving_averages(p.sbars, 5, 20), "ma5", "ma20")


@query(
    "weekly_ma",
    f""", l AS (SELECT id, CAST(DATE_TRUNC('week', d) AS DATE) AS week, ARG_MAX(close, d) AS close FROM sbars GROUP BY ALL),
    s AS (SELECT id, CAST(UNNEST(GENERATE_SERIES(MIN(week), MAX(week), INTERVAL 7 DAY)) AS DATE) AS week FROM l GROUP BY id),
    f AS (SELECT id, week, LAST_VALUE(l.close IGNORE NULLS) OVER (PARTITION BY id ORDER BY week ROWS UNBOUNDED PRECEDING) AS close FROM s LEFT JOIN l USING (id, week))
    SELECT id, week, {R4("close")} AS close, {R4("AVG(close) OVER (PARTITION BY id ORDER BY week ROWS 19 PRECEDING)")} AS weekly_ma FROM f""",
)
def weekly_ma(p):
    return T.weekly_average(p.sbars).select("id", "week", r4(F.col("close")).alias("close"), r4(F.col("weekly_ma")).alias("weekly_ma"))


def _ewm(v, span):
    """The fold itself, over all values so far."""
    a = 2.0 / (span + 1)
    return f"LIST_REDUCE(LIST({v}) OVER ({P} ROWS UNBOUNDED PRECEDING), LAMBDA y, x: {1 - a!r}::DOUBLE * y + {a!r}::DOUBLE * x)"


@query(
    "macd",
    f""", m AS (SELECT id, d, t, close, {_ewm("close", 12)} - {_ewm("close", 26)} AS macd, {roll("AVG", "close", 20)} AS mid FROM sbars),
    s AS (SELECT *, {_ewm("macd", 9)} AS signal FROM m), l AS (SELECT *, LAG(macd) OVER w AS m0, LAG(signal) OVER w AS s0 FROM s {W}),
    c AS (SELECT *, m0 <= s0 AND macd > signal AS up, m0 >= s0 AND macd < signal AS down FROM l)
    SELECT id, d, {R4("macd")} AS macd, {R4("signal")} AS signal, CASE WHEN up THEN 'golden' WHEN down THEN 'death' ELSE 'none' END AS "cross",
        CASE WHEN t < 26 THEN NULL WHEN up AND macd > 0 THEN 'bullish_strong' WHEN up AND macd < 0 AND macd > mid * -0.2::DOUBLE THEN 'bullish_recovery' WHEN down THEN 'bearish' WHEN macd > signal THEN 'neutral' ELSE 'bearish' END AS macd_status
    FROM c WHERE t >= 10""",
)
def macd(p):
    return T.macd(p.sbars).where("t >= 10").select("id", "d", r4(F.col("macd")).alias("macd"), r4(F.col("signal")).alias("signal"), "cross", "macd_status")


@query(
    "ewm",
    f"""SELECT id, d, {R4(_ewm("close", 20))} AS ewm20 FROM sbars""",
)
def ewm(p):
    return shown(S.smoothed(p.sbars, F.col("t") - 1, ewm20=("close", 20)), "ewm20")


@query(
    "bollinger",
    f""", m AS (SELECT id, d, close, {roll("AVG", "close", 20)} AS ma, {roll("STDDEV_SAMP", "close", 20)} AS sd FROM sbars),
    b AS (SELECT *, ma + sd * 2 AS upper, ma - sd * 2 AS lower, (ma + sd * 2 - (ma - sd * 2)) / ma AS bandwidth FROM m), u AS (SELECT *, {roll("AVG", "bandwidth", 20)} AS usual FROM b)
    SELECT id, d, {R4("upper")} AS upper, {R4("lower")} AS lower, {R4("bandwidth")} AS bandwidth, {R4("CASE WHEN upper - lower > 0 THEN (close - lower) / (upper - lower) END")} AS percent_b,
        CASE WHEN bandwidth < usual * 0.8::DOUBLE THEN 'squeezing' ELSE 'expanding' END AS bb_status FROM u""",
)
def bollinger(p):
    return shown(T.bollinger(p.sbars), "upper", "lower", "bandwidth", "percent_b", keep=["bb_status"])


@query(
    "rsi14",
    f""", g AS (SELECT id, d, close - LAG(close) OVER w AS c FROM sbars {W}), h AS (SELECT id, d, CASE WHEN c > 0 THEN c WHEN c IS NOT NULL THEN 0::DOUBLE END AS gain, CASE WHEN c < 0 THEN -c WHEN c IS NOT NULL THEN 0::DOUBLE END AS loss FROM g)
    SELECT id, d, {R4(f"100 - 100 / (1 + {roll('AVG', 'gain', 14)} / NULLIF({roll('AVG', 'loss', 14)}, 0))")} AS rsi FROM h""",
)
def rsi14(p):
    return shown(T.rsi(p.sbars), "rsi")


@query(
    "kdj",
    f""", r AS (SELECT id, d, (close - MIN(low) OVER l) / NULLIF(MAX(high) OVER l - MIN(low) OVER l, 0) * 100 AS rsv FROM sbars WINDOW l AS ({P} ROWS 8 PRECEDING)),
    k AS (SELECT *, AVG(rsv) OVER ({P} ROWS 8 PRECEDING) AS k FROM r), e AS (SELECT *, AVG(k) OVER ({P} ROWS 8 PRECEDING) AS d_ FROM k)
    SELECT id, d, {R4("k")} AS k, {R4("d_")} AS d_, {R4("3 * k - 2 * d_")} AS j FROM e""",
)
def kdj(p):
    return shown(T.kdj(p.sbars), "k", "d_", "j")


_TR = "GREATEST(high - low, COALESCE(ABS(high - LAG(close) OVER w), 0), COALESCE(ABS(low - LAG(close) OVER w), 0))"


@query("atr14", f", r AS (SELECT id, d, {_TR} AS tr FROM sbars {W}) SELECT id, d, {R4(f'AVG(tr) OVER ({P} ROWS 13 PRECEDING)')} AS atr FROM r")
def atr14(p):
    return shown(T.atr(p.sbars), "atr")


@query(
    "obv",
    f""", r AS (SELECT id, d, close, volume, volume / {roll("AVG", "volume", 20)} AS volume_ratio, COALESCE(SIGN(close - LAG(close) OVER w), 0) * volume AS s, close > LAG(close) OVER w AS up FROM sbars {W}),
    o AS (SELECT *, (SUM(s) OVER ({P} ROWS UNBOUNDED PRECEDING))::DOUBLE AS obv FROM r)
    SELECT id, d, {R4("volume_ratio")} AS volume_ratio, obv, obv > {roll("AVG", "obv", 20, 10)} AS obv_above_ma20, COALESCE(up AND volume_ratio < 1, false) AS divergence FROM o""",
)
def obv(p):
    return shown(T.on_balance(p.sbars), "volume_ratio", keep=["obv", "obv_above_ma20", "divergence"])


@query(
    "ma_cross",
    f""", m AS (SELECT id, d, {roll("AVG", "close", 20)} AS a, {roll("AVG", "close", 60)} AS b FROM sbars), l AS (SELECT *, LAG(a) OVER w AS a0, LAG(b) OVER w AS b0 FROM m {W})
    SELECT id, d, CASE WHEN a0 <= b0 AND a > b THEN 'golden_cross' WHEN a0 >= b0 AND a < b THEN 'death_cross' ELSE 'neutral' END AS ma_cross FROM l""",
)
def ma_cross(p):
    return T.ma_cross(p.sbars).select("id", "d", "ma_cross")


@query("bias_spike", f"SELECT id, d, {R4(f'(close - {roll("AVG", "close", 20, 1)}) / {roll("AVG", "close", 20, 1)} * 100')} AS bias, {R4(f'volume / {roll("AVG", "volume", 20, 1)}')} AS spike FROM sbars")
def bias_spike(p):
    return shown(T.bias_and_spike(p.sbars), "bias", "spike")


@query("mom_skip", f"SELECT id, d, {R4('COALESCE((LAG(close, 5) OVER w / NULLIF(LAG(close, 65) OVER w, 0) - 1) * 100, 0)')} AS mom FROM sbars {W}")
def mom_skip(p):
    return shown(T.momentum(p.sbars, 60, 5), "mom")


_EW = f""", r AS (SELECT id, d, close / LAG(close) OVER w - 1 AS r FROM sbars {W}), day AS (SELECT d, AVG(r) AS ret, COUNT(r) AS n FROM r WHERE ABS(r) < 0.5 GROUP BY d),
    idx AS (SELECT d, ret, n, EXP(SUM(LN(1 + ret)) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING)) AS level FROM day)"""


def ew_index(p):
    """d, ret, n, level: the equal-weight index of all entities."""
    r = p.sbars.select("id", "d", S.change("close").alias("r")).where(F.abs("r") < 0.5)
    day = r.groupBy("d").agg(F.avg("r").alias("ret"), F.count("r").alias("n"))
    return day.withColumn("level", F.exp(F.sum(F.ln(1 + F.col("ret"))).over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))))


@query(
    "rel_strength",
    _EW + f""", m AS (SELECT id, d, (close / LAG(close, 60) OVER w - 1) * 100 AS mom FROM sbars {W}), b AS (SELECT d, (level / LAG(level, 60) OVER (ORDER BY d) - 1) * 100 AS mom FROM idx)
    SELECT id, d, {R4("m.mom - b.mom", 2)} AS rs FROM m LEFT JOIN b USING (d)""",
)
def rel_strength(p):
    own = p.sbars.select("id", "d", (S.change("close", 60) * 100).alias("mom"))
    w = Window.orderBy("d")
    bench = ew_index(p).select("d", ((F.col("level") / F.lag("level", 60).over(w) - 1) * 100).alias("bench"))
    return own.join(bench, "d", "left").select("id", "d", r4(F.col("mom") - F.col("bench"), 2).alias("rs"))


@query(
    "ew_index",
    _EW + f"""
    SELECT d, n, {R4("level")} AS level, {R4("level / AVG(level) OVER (ORDER BY d ROWS 199 PRECEDING) - 1")} AS dist200, {R4("STDDEV_SAMP(ret) OVER (ORDER BY d ROWS 59 PRECEDING) * SQRT(252)")} AS vol60 FROM idx""",
)
def ew_index_query(p):
    w = Window.orderBy("d")
    return ew_index(p).select(
        "d", "n", r4(F.col("level")).alias("level"), r4(F.col("level") / F.avg("level").over(w.rowsBetween(-199, 0)) - 1).alias("dist200"),
        r4(F.stddev_samp("ret").over(w.rowsBetween(-59, 0)) * F.sqrt(F.lit(252.0))).alias("vol60"),
    )


@query(
    "chase_band",
    f""", r AS (SELECT id, d, close, close / LAG(close) OVER w - 1 AS r, {_TR} AS tr FROM sbars {W}),
    v AS (SELECT id, d, GREATEST(COALESCE({roll("STDDEV_SAMP", "r", 90, 3)}, 0) * 100, AVG(tr) OVER ({P} ROWS 13 PRECEDING) / close * 100) AS vol FROM r)
    SELECT id, d, {R4("LEAST(GREATEST(vol * 15::DOUBLE, 15), 45)")} AS band FROM v""",
)
def chase_band(p):
    return shown(T.chase_band(p.sbars), "band")


@query(
    "back_adjust",
    f""", c AS (SELECT id, d, cents::DOUBLE / volume / 100 AS close FROM bars), j AS (SELECT *, close / LAG(close) OVER w AS j FROM c {W}), l AS (SELECT *, CASE WHEN j < 0.7 OR j > 1.5 THEN LN(j) ELSE 0 END AS ln FROM j)
    SELECT id, d, {R4(f"COALESCE(SUM(ln) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)")} AS log_factor FROM l""",
)
def back_adjust(p):
    raw = p.bars.select("id", "d", (F.col("cents").cast("double") / F.col("volume") / 100).alias("close"))
    return T.back_adjusted(raw).select("id", "d", r4(F.ln(F.col("adjusted") / F.col("close"))).alias("log_factor"))


@query(
    "split_adjust",
    f""", c AS (SELECT id, d, cents::DOUBLE / volume / 100 AS close FROM bars), j AS (SELECT *, close / LAG(close) OVER w AS j FROM c {W}),
    l AS (SELECT *, CASE WHEN j < 0.5 THEN LN(GREATEST(ROUND_EVEN(1 / j, 0), 1)) ELSE 0 END AS ln FROM j)
    SELECT id, d, {R4(f"COALESCE(SUM(ln) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)")} AS split_log FROM l""",
)
def split_adjust(p):
    """As logarithms: years of these prices' falls multiply to more than a BIGINT holds."""
    raw = p.bars.select("id", "d", (F.col("cents").cast("double") / F.col("volume") / 100).alias("close"))
    return T.split_logs(raw).select("id", "d", r4(F.col("split_log")).alias("split_log"))


@query(
    "scale_guard",
    f""", c AS (SELECT id, d, cents::DOUBLE / volume / 100 AS close FROM bars), j AS (SELECT *, LAG(close) OVER w AS b, QUANTILE_CONT(close, 0.5) OVER ({P} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS md FROM c {W})
    SELECT id, d, {R4("CASE WHEN (close / b < 0.4 OR close / b > 2.5) AND ABS(close / md - 1) > 0.6 THEN b ELSE close END")} AS stable FROM j""",
)
def scale_guard(p):
    return shown(T.scale_guard(p.bars.select("id", "d", (F.col("cents").cast("double") / F.col("volume") / 100).alias("close"))), "stable")


@query(
    "vol_conc",
    f""", u AS (SELECT id, d, volume, CASE WHEN close > LAG(close) OVER w THEN volume ELSE 0 END AS up FROM sbars {W})
    SELECT id, d, {R4(f"(SUM(up) OVER ({P} ROWS 19 PRECEDING))::DOUBLE / (SUM(volume) OVER ({P} ROWS 19 PRECEDING))::DOUBLE * 100")} AS concentration FROM u""",
)
def vol_conc(p):
    return shown(T.volume_concentration(p.sbars), "concentration")


@query(
    "tech_panel",
    f""", g AS (SELECT *, close - LAG(close) OVER w AS c, close / LAG(close) OVER w - 1 AS r FROM sbars {W}), h AS (SELECT *, CASE WHEN c > 0 THEN c WHEN c IS NOT NULL THEN 0::DOUBLE END AS gain, CASE WHEN c < 0 THEN -c WHEN c IS NOT NULL THEN 0::DOUBLE END AS loss FROM g),
    m AS (SELECT *, {roll("AVG", "close", 20)} AS ma, {roll("STDDEV_SAMP", "close", 20)} AS sd FROM h)
    SELECT id, d, {R4(f"100 - 100 / (1 + {roll('AVG', 'gain', 14)} / NULLIF({roll('AVG', 'loss', 14)}, 0))")} AS rsi14, {R4("CASE WHEN sd > 0 THEN (close - (ma - 2 * sd)) / (ma + 2 * sd - (ma - 2 * sd)) END")} AS bbp20,
        {R4(f"close / {roll('AVG', 'close', 60)} - 1")} AS ma_gap60, {R4(roll("STDDEV_SAMP", "r", 60, 40))} AS vol60, {R4(f"close / {roll('MAX', 'close', 240, 120)} * 100")} AS high52 FROM m""",
)
def tech_panel(p):
    return shown(T.technical_panel(p.sbars), "rsi14", "bbp20", "ma_gap60", "vol60", "high52")


@query("high52", f"SELECT id, d, {R4(f'close / {roll("MAX", "close", 240, 120)} * 100')} AS high52 FROM sbars")
def high52(p):
    return shown(p.sbars.withColumn("high52", F.col("close") / S.highest("close", 240, 120) * 100), "high52")


@query(
    "vol_profile_poc",
    """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) AS n FROM sbars), l AS (SELECT *, MIN(close) OVER (PARTITION BY id) AS lo, MAX(close) OVER (PARTITION BY id) AS hi FROM n WHERE n <= 90),
    b AS (SELECT id, lo, hi, LEAST(29, FLOOR((close - lo) / ((hi - lo) / 30))::INT) AS bin, SUM(volume)::BIGINT AS v FROM l WHERE hi > lo GROUP BY ALL),
    r AS (SELECT *, COALESCE(SUM(v) OVER (PARTITION BY id ORDER BY v DESC, bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(v) OVER (PARTITION BY id) AS total, ROW_NUMBER() OVER (PARTITION BY id ORDER BY v DESC, bin DESC) AS rn FROM b),
    s AS (SELECT id, lo, hi, MAX(bin) FILTER (rn = 1) AS p, MIN(bin) AS a, MAX(bin) AS z FROM r WHERE before < total * 0.7::DOUBLE GROUP BY ALL)
    SELECT id, ROUND_EVEN(lo + (p + 0.5::DOUBLE) * (hi - lo) / 30, 2) AS poc, ROUND_EVEN(lo + (a + 0.5::DOUBLE) * (hi - lo) / 30, 2) AS val, ROUND_EVEN(lo + (z + 0.5::DOUBLE) * (hi - lo) / 30, 2) AS vah FROM s""",
)
def vol_profile_poc(p):
    return T.volume_profile(p.sbars)


@query(
    "multi_tf",
    f""", mon AS (SELECT id, DATE_TRUNC('month', d)::DATE AS d, ARG_MAX(close, d) AS close FROM sbars GROUP BY ALL), wk AS (SELECT id, DATE_TRUNC('week', d)::DATE AS d, ARG_MAX(close, d) AS close FROM sbars GROUP BY ALL),
    a AS (SELECT 'month' AS tf, * FROM mon UNION ALL SELECT 'week', * FROM wk)
    SELECT tf, id, d, {R4("AVG(close) OVER (PARTITION BY tf, id ORDER BY d ROWS 4 PRECEDING)")} AS ma5, {R4("close / LAG(close) OVER (PARTITION BY tf, id ORDER BY d) - 1")} AS ret FROM a""",
)
def multi_tf(p):
    of = lambda tf: p.sbars.groupBy(F.lit(tf).alias("tf"), "id", F.trunc("d", tf).alias("_d")).agg(F.max_by("close", "d").alias("close")).withColumnRenamed("_d", "d")
    s = Series(["tf", "id"])
    return of("month").unionByName(of("week")).select("tf", "id", "d", r4(s.mean("close", 5, 1)).alias("ma5"), r4(s.change("close")).alias("ret"))


# --- window idioms ---


@query("cs_pct_rank", f"SELECT id, d, {R4(avg_rank_sql('volume', 'd'))} AS pct FROM sbars")
def cs_pct_rank(p):
    return p.sbars.select("id", "d", r4(pct_rank("volume", "d")).alias("pct"))


@query(
    "industry_rank",
    f", j AS (SELECT s.id, d, volume, industry FROM sbars s JOIN dim USING (id)) SELECT id, d, {R4(f'CASE WHEN COUNT(volume) OVER (PARTITION BY d, industry) >= 2 THEN {avg_rank_sql("volume", "d, industry")} ELSE {avg_rank_sql("volume", "d")} END')} AS pct FROM j",
)
def industry_rank(p):
    j = p.sbars.join(F.broadcast(p.dim.select("id", "industry")), "id")
    return j.select("id", "d", r4(grouped_pct_rank("volume", "d", "industry", 2)).alias("pct"))


@query(
    "expanding_pct",
    f"SELECT a.id, a.d, {R4('CASE WHEN COUNT(*) >= 60 THEN COUNT(*) FILTER (b.close < a.close) * 100.0::DOUBLE / COUNT(*) END')} AS pct FROM sbars a JOIN sbars b ON a.id = b.id AND b.d <= a.d GROUP BY a.id, a.d",
)
def expanding(p):
    return expanding_pct(p.sbars, "id", "d", "close").select("id", "d", r4(F.col("pct")).alias("pct"))


@query("rolling_stats", f"SELECT id, d, {R4(roll('AVG', 'volume', 10))} AS mean10, {roll('SUM', 'volume', 20)}::BIGINT AS sum20, {roll('MAX', 'volume', 60, 20)} AS max60, {R4(roll('STDDEV_SAMP', 'volume', 20, 5))} AS sd20 FROM sbars")
def rolling_stats(p):
    return p.sbars.select("id", "d", r4(S.mean("volume", 10)).alias("mean10"), S.total("volume", 20).alias("sum20"), S.highest("volume", 60, 20).alias("max60"), r4(S.std("volume", 20, 5)).alias("sd20"))


@query("adv20", f"SELECT id, d, {R4(f'(SUM(volume) OVER ({P} ROWS 19 PRECEDING))::DOUBLE / COUNT(*) OVER ({P} ROWS 19 PRECEDING)')} AS adv20, MIN(d) OVER (PARTITION BY id) AS first_date FROM bars")
def adv20(p):
    last = S.last(20)
    mean = F.sum("volume").over(last).cast("double") / F.count("*").over(last)
    return p.bars.select("id", "d", r4(mean).alias("adv20"), F.min("d").over(Window.partitionBy("id")).alias("first_date"))


@query("returns_k", f"SELECT id, d, {R4('close / LAG(close, 1) OVER w - 1')} AS r1, {R4('close / LAG(close, 5) OVER w - 1')} AS r5, {R4('close / LAG(close, 20) OVER w - 1')} AS r20 FROM sbars {W}")
def returns_k(p):
    return p.sbars.select("id", "d", *[r4(S.change("close", k)).alias(f"r{k}") for k in (1, 5, 20)])


@query("fwd_return", f"SELECT id, d, {R4('(LEAD(close, 20) OVER w / close - 1) * 100')} AS fwd FROM sbars {W}")
def fwd_return(p):
    return p.sbars.select("id", "d", r4((S.lead("close", 20) / F.col("close") - 1) * 100).alias("fwd"))


@query("excess", f", f AS (SELECT id, d, (LEAD(close, 20) OVER w / close - 1) * 100 AS f FROM sbars {W}) SELECT id, d, {R4('f - AVG(f) OVER (PARTITION BY d)')} AS excess FROM f")
def excess(p):
    f = p.sbars.select("id", "d", ((S.lead("close", 20) / F.col("close") - 1) * 100).alias("f"))
    return f.select("id", "d", r4(F.col("f") - F.avg("f").over(Window.partitionBy("d"))).alias("excess"))


@query("equity_curve", f", r AS (SELECT id, d, close / LAG(close) OVER w - 1 AS r FROM sbars {W}), e AS (SELECT id, d, EXP(SUM(LN(1 + r)) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS eq FROM r) SELECT id, d, {R4('eq')} AS equity, {R4('eq / MAX(eq) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING) - 1')} AS drawdown FROM e")
def equity_curve(p):
    e = p.sbars.withColumn("r", S.change("close")).withColumn("eq", F.exp(F.sum(F.ln(1 + F.col("r"))).over(S.past)))
    return e.select("id", "d", r4(F.col("eq")).alias("equity"), r4(F.col("eq") / F.max("eq").over(S.past) - 1).alias("drawdown"))


@query("ffill", "SELECT id, d, LAST_VALUE(CASE WHEN volume > 30 THEN volume END IGNORE NULLS) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING) AS last, FIRST_VALUE(CASE WHEN volume > 30 THEN volume END IGNORE NULLS) OVER (PARTITION BY id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM sbars")
def ffill(p):
    big = F.when(F.col("volume") > 30, F.col("volume"))
    return p.sbars.select("id", "d", S.filled(big).alias("last"), F.first(big, ignorenulls=True).over(S.w.rowsBetween(0, Window.unboundedFollowing)).alias("next"))


@query("topk_basket", ", m AS (SELECT id, LAST_DAY(d) AS m, SUM(volume)::BIGINT AS v FROM sbars GROUP BY ALL) SELECT m, id, v FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY m ORDER BY v DESC, id) <= 8")
def topk_basket(p):
    m = p.sbars.groupBy("id", F.last_day("d").alias("m")).agg(F.sum("volume").alias("v"))
    return m.withColumn("n", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("v"), "id"))).where("n <= 8").select("m", "id", "v")


@query("month_last", f"SELECT id, LAST_DAY(d) AS m, {R4('ARG_MAX(close, d)')} AS close FROM sbars GROUP BY ALL")
def month_last(p):
    return p.sbars.groupBy("id", F.last_day("d").alias("m")).agg(F.max_by("close", "d").alias("close")).select("id", "m", r4(F.col("close")).alias("close"))


@query("rebalance_dates", "SELECT 'month' AS kind, MAX(d) AS d FROM sbars GROUP BY DATE_TRUNC('month', d) UNION ALL SELECT 'week', MAX(d) FROM sbars GROUP BY DATE_TRUNC('week', d)")
def rebalance_dates(p):
    of = lambda k: p.sbars.groupBy(F.trunc("d", k).alias("_k")).agg(F.max("d").alias("d")).select(F.lit(k).alias("kind"), "d")
    return of("month").unionByName(of("week"))


@query("quarterly_grid", ", m AS (SELECT MAX(d) AS d FROM sbars GROUP BY DATE_TRUNC('month', d)) SELECT d FROM m QUALIFY (ROW_NUMBER() OVER (ORDER BY d) - 1) % 3 = 0")
def quarterly_grid(p):
    m = p.sbars.groupBy(F.trunc("d", "month").alias("_m")).agg(F.max("d").alias("d"))
    return m.withColumn("n", F.row_number().over(Window.orderBy("d"))).where("(n - 1) % 3 = 0").select("d")


@query("tail_n", f"SELECT id, {R4('AVG(volume)')} AS mean FROM (SELECT * FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) <= 20) GROUP BY id")
def tail_n(p):
    last = p.bars.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("d")))).where("n <= 20")
    return last.groupBy("id").agg(F.avg("volume").alias("mean")).select("id", r4(F.col("mean")).alias("mean"))


@query("top_pct", "SELECT d, id FROM sbars QUALIFY ROW_NUMBER() OVER (PARTITION BY d ORDER BY close DESC, id) <= GREATEST(1, FLOOR(COUNT(*) OVER (PARTITION BY d) * 0.2::DOUBLE))")
def top_pct(p):
    by = Window.partitionBy("d")
    rows = p.sbars.withColumns({"n": F.row_number().over(by.orderBy(F.desc("close"), "id")), "k": F.greatest(F.lit(1), F.floor(F.count("*").over(by) * 0.2))})
    return rows.where("n <= k").select("d", "id")


@query("market_position", f""", m AS (SELECT id, d, close, {roll("AVG", "close", 60)} AS ma60, {roll("AVG", "close", 200)} AS ma200, MIN(close) OVER l AS lo, MAX(close) OVER l AS hi FROM sbars WINDOW l AS ({P} ROWS 239 PRECEDING))
    SELECT id, d, CASE WHEN close > ma60 AND ma60 > ma200 THEN 'up' WHEN close < ma60 AND ma60 < ma200 THEN 'down' ELSE 'mixed' END AS trend,
        CASE WHEN (close - lo) / NULLIF(hi - lo, 0) * 100 >= 80 THEN 'high' WHEN (close - lo) / NULLIF(hi - lo, 0) * 100 <= 20 THEN 'low' ELSE 'middle' END AS place
    FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) = 1""")  # fmt: skip
def market_position(p):
    rows = p.sbars.withColumns({"ma60": S.mean("close", 60), "ma200": S.mean("close", 200), "lo": S.lowest("close", 240, 1), "hi": S.highest("close", 240, 1)})
    pct = (F.col("close") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * 100
    trend = F.when(F.expr("close > ma60 AND ma60 > ma200"), "up").when(F.expr("close < ma60 AND ma60 < ma200"), "down").otherwise("mixed")
    return latest_row(rows, ["id"], F.desc("d")).select("id", "d", trend.alias("trend"), F.when(pct >= 80, "high").when(pct <= 20, "low").otherwise("middle").alias("place"))
