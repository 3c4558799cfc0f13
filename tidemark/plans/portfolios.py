"""Regime, exit, portfolio and simulation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import portfolio as B
from tidemark.operators import regime as K
from tidemark.operators.asof import asof_join
from tidemark.operators.windows import Series, debounced

from tidemark.functions.ranks import quantiles

from .base import R4, dealt, query, r4
from .factors import _ERA_SQL, COHORT, OBS, SCORED, cohorts, eras, finite, ic_sql, observations, scored, summary, IC_COLS
from .technicals import _EW, ew_index, roll

from tidemark.operators import factors as X

S = Series()

# --- regimes over each entity's series (the equal-weight index is one more entity) ---

_RUNS = """l AS (SELECT *, LAG(raw) OVER (PARTITION BY id ORDER BY d) AS b FROM src), m AS (SELECT *, SUM(CASE WHEN b IS NULL OR b <> raw THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING) AS g FROM l),
    n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, g ORDER BY d) AS run FROM m), e AS (SELECT *, CASE WHEN run >= CASE WHEN raw THEN {up} ELSE {down} END THEN raw END AS ev FROM n),
    st AS (SELECT id, d, raw, COALESCE(LAST_VALUE(ev IGNORE NULLS) OVER q, FIRST_VALUE(raw) OVER q) AS state FROM e WINDOW q AS (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING))"""


@query("debounce", f", src AS (SELECT id, d, close > {roll('AVG', 'close', 50)} AS raw FROM sbars QUALIFY COUNT(close) OVER (PARTITION BY id ORDER BY d ROWS 49 PRECEDING) >= 50), " + _RUNS.format(up=3, down=3) + " SELECT id, d, raw, state FROM st")
def debounce(p):
    rows = p.sbars.select("id", "d", (F.col("close") > S.mean("close", 50)).alias("raw")).where("raw IS NOT NULL")
    return debounced(rows, ["id"], "d", "raw", 3, 3).select("id", "d", "raw", "state")


_INDEX_RUNS = "SELECT d, state FROM (WITH src AS (SELECT id, d, level > ma AS raw FROM im), " + _RUNS.format(up=3, down=3) + " SELECT * FROM st)"


def _ladder_sql(k):
    return f"SELECT id, d, state FROM (WITH src AS (SELECT id, d, close > ma{k} AS raw FROM mas), " + _RUNS.format(up=3, down=3) + " SELECT * FROM st)"


LADDER = f", mas AS (SELECT * FROM (SELECT id, d, close, {roll('AVG', 'close', 50)} AS ma50, {roll('AVG', 'close', 100)} AS ma100, {roll('AVG', 'close', 200)} AS ma200 FROM sbars) WHERE ma200 IS NOT NULL), " + ", ".join(f"s{k} AS ({_ladder_sql(k)})" for k in (50, 100, 200))


@query("exposure_ladder", LADDER + f" SELECT a.id, a.d, {R4('(a.state::INT + b.state::INT + c.state::INT) / 3.0::DOUBLE')} AS exposure FROM s50 a JOIN s100 b USING (id, d) JOIN s200 c USING (id, d)")
def ladder(p):
    return K.exposure_ladder(p.sbars).select("id", "d", r4(F.col("exposure")).alias("exposure"))


REGIME = f""", wk AS (SELECT id, CAST(DATE_TRUNC('week', d) AS DATE) AS wk, ARG_MAX(close, d) AS wc FROM sbars GROUP BY ALL), wm AS (SELECT *, CASE WHEN COUNT(wc) OVER q >= 24 THEN AVG(wc) OVER q END AS wma FROM wk WINDOW q AS (PARTITION BY id ORDER BY wk ROWS 23 PRECEDING)),
    wl AS (SELECT *, LAG(wma, 4) OVER (PARTITION BY id ORDER BY wk) AS w0 FROM wm), wn AS (SELECT id, wk, CASE WHEN wc > wma AND wma > w0 THEN 'bull' WHEN wc < wma AND NOT COALESCE(wma > w0, false) THEN 'bear' ELSE 'neutral' END AS now FROM wl),
    wp AS (SELECT *, LAG(now) OVER (PARTITION BY id ORDER BY wk) AS prev FROM wn), dl AS (SELECT id, d, close, {roll("AVG", "close", 120)} AS ma FROM sbars), dm AS (SELECT *, LAG(ma, 20) OVER (PARTITION BY id ORDER BY d) AS ma0 FROM dl),
    dr AS (SELECT dm.*, CASE WHEN DAYOFWEEK(d) IN (5, 6, 0) THEN now ELSE COALESCE(prev, 'neutral') END AS weekly, CASE WHEN close < ma * 0.93::DOUBLE THEN 'bear_fast' WHEN close > ma AND ma > ma0 THEN 'bull' WHEN close < ma AND NOT ma > ma0 THEN 'bear' ELSE 'neutral' END AS r
        FROM dm LEFT JOIN wp ON wp.id = dm.id AND wp.wk = CAST(DATE_TRUNC('week', d) AS DATE)),
    reg AS (SELECT id, d, CASE WHEN ma IS NULL OR ma0 IS NULL OR (r IN ('bull', 'bear') AND weekly <> 'neutral' AND weekly <> r) THEN 'neutral' ELSE r END AS raw FROM dr)"""


@query("regime_raw", REGIME + " SELECT id, d, raw FROM reg")
def regime_raw(p):
    return K.raw_regime(p.sbars).select("id", "d", "raw")


@query("regime_share", REGIME + f" SELECT raw, COUNT(*) AS n, {R4('COUNT(*)::DOUBLE / (SUM(COUNT(*)) OVER ())::DOUBLE')} AS share FROM reg GROUP BY raw")
def regime_share(p):
    g = K.raw_regime(p.sbars).groupBy("raw").agg(F.count("*").alias("n"))
    return g.select("raw", "n", r4(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy()).cast("double")).alias("share"))


@query("regime_hyst")
def regime_hyst(p):
    return K.hysteresis(K.raw_regime(p.sbars))


@query("whipsaw", REGIME + ", w AS (SELECT *, LAG(raw) OVER q AS before FROM reg WINDOW q AS (PARTITION BY id ORDER BY d)), s AS (SELECT * FROM w WHERE before <> raw), t AS (SELECT *, LEAD(d) OVER q AS nd, LEAD(raw) OVER q AS nr FROM s WINDOW q AS (PARTITION BY id ORDER BY d)) SELECT id, d, raw FROM t WHERE nd - d <= 10 AND nr = before")
def whipsaw(p):
    return K.whipsaws(K.raw_regime(p.sbars).select("id", "d", "raw"), "id", "d", "raw")


@query("episodes", REGIME + ", b AS (SELECT DISTINCT id, YEAR(d) * 12 + MONTH(d) AS k FROM reg WHERE raw LIKE 'bear%'), g AS (SELECT *, CASE WHEN COALESCE(k - LAG(k) OVER q > 2, true) THEN 1 ELSE 0 END AS new FROM b WINDOW q AS (PARTITION BY id ORDER BY k)), e AS (SELECT *, (SUM(new) OVER (PARTITION BY id ORDER BY k))::BIGINT AS episode FROM g) SELECT id, episode, MIN(k) AS first, MAX(k) AS last, COUNT(*) AS n FROM e GROUP BY ALL")
def episodes(p):
    months = K.raw_regime(p.sbars).where("raw LIKE 'bear%'").select("id", (F.year("d") * 12 + F.month("d")).cast("long").alias("k")).distinct()
    return K.episodes(months, "id", "k")


@query("asof_regime", _EW + f", im AS (SELECT * FROM (SELECT 1 AS id, d, level, AVG(level) OVER w AS ma, COUNT(level) OVER w AS n FROM idx WINDOW w AS (ORDER BY d ROWS 199 PRECEDING)) WHERE n = 200), ix AS ({_INDEX_RUNS}), o AS (SELECT id, d FROM sbars) SELECT o.id, o.d, COALESCE(ix.state, false) AS up FROM o ASOF LEFT JOIN ix ON o.d >= ix.d")
def asof_regime(p):
    """Whether the market's index is confirmed above its mean of 200 days, as known on each entity's days."""
    return p.sbars.select("id", "d").join(regime_by_day(p), "d").select("id", "d", "up")


def regime_by_day(p):
    """d, up: the index's state on each day that any entity has; one row a day, so its one partition is bounded by the calendar."""
    index = ew_index(p).select(F.lit(1).alias("k"), "d", "level")
    one = K.exposure_ladder(index, "k", "d", "level", (200,)).select("k", F.col("d").alias("known"), F.col("above200").alias("state"))
    days = p.sbars.select(F.lit(1).alias("k"), "d").distinct()
    return asof_join(days, one, ["k"], "d", "known").select("d", F.coalesce("state", F.lit(False)).alias("up"))


@query("bull_attr", OBS + f", b AS (SELECT d, CASE WHEN AVG(mom) > 3 THEN 'bull' WHEN AVG(mom) < -3 THEN 'bear' ELSE 'neutral' END AS regime FROM obs WHERE mom IS NOT NULL GROUP BY d), {ic_sql('hi')} SELECT regime, {IC_COLS} FROM ic JOIN b USING (d) WHERE NOT ISNAN(ic) GROUP BY regime")
def bull_attr(p):
    o = observations(p)
    m = F.avg("mom")
    label = o.where("mom IS NOT NULL").groupBy("d").agg(F.when(m > 3, "bull").when(m < -3, "bear").otherwise("neutral").alias("regime"))
    return summary(X.rank_ic(o, "hi", "fwd", "d").join(label, "d"), "regime")


# --- monthly portfolios ---

HELD = COHORT + """, held AS MATERIALIZED (SELECT a.i, COUNT(*) AS n, 1 - COUNT(b.id)::DOUBLE / COUNT(*) AS turnover, AVG(a.fwd) / 100 AS gross FROM coh a LEFT JOIN coh b ON b.i = a.i - 1 AND b.id = a.id GROUP BY a.i HAVING AVG(a.fwd) IS NOT NULL),
    nets AS MATERIALIZED (SELECT *, gross - turnover * 0.00585::DOUBLE AS net FROM held)"""
CURVE = HELD + """, eqs AS (SELECT *, EXP(SUM(LN(1 + net)) OVER (ORDER BY i)) AS equity FROM nets), curve AS MATERIALIZED (SELECT *, equity / GREATEST(MAX(equity) OVER (ORDER BY i), 1) - 1 AS drawdown FROM eqs)"""


def nets(p):
    return B.held_returns(cohorts(p))


@query("monthly_net", HELD + f" SELECT i, n, {R4('turnover')} AS turnover, {R4('gross')} AS gross, {R4('net')} AS net FROM nets")
def monthly_net(p):
    return nets(p).select("i", "n", *[r4(F.col(c)).alias(c) for c in ("turnover", "gross", "net")])


@query("ranked_curve", CURVE + f" SELECT i, {R4('equity')} AS equity, {R4('drawdown')} AS drawdown FROM curve")
def ranked_curve(p):
    return B.curve(nets(p)).select("i", r4(F.col("equity")).alias("equity"), r4(F.col("drawdown")).alias("drawdown"))


_M = f"COUNT(*) AS n, {R4('EXP(SUM(LN(1 + net))) - 1')} AS total, {R4('POW(EXP(SUM(LN(1 + net))), 12.0::DOUBLE / COUNT(*)) - 1')} AS cagr, {R4('STDDEV_SAMP(net) * SQRT(12)')} AS vol, {R4('MIN(drawdown)')} AS mdd, {R4('AVG((net > 0)::INT)')} AS win"


@query("curve_metrics", CURVE + f" SELECT {_M} FROM curve")
def curve_metrics(p):
    m = B.metrics(B.curve(nets(p)))
    return m.select("n", *[r4(F.col(c)).alias(c) for c in ("total", "cagr", "vol", "mdd", "win")])


@query("metrics_ext", CURVE + f", m AS (SELECT POW(EXP(SUM(LN(1 + net))), 12.0::DOUBLE / COUNT(*)) - 1 AS c, STDDEV_SAMP(net) * SQRT(12) AS v, STDDEV_SAMP(net) FILTER (net < 0) * SQRT(12) AS dn, MIN(drawdown) AS dd, MAX(net) AS best, MIN(net) AS worst FROM curve) SELECT {R4('(c - 0.01::DOUBLE) / NULLIF(v, 0)')} AS sharpe, {R4('(c - 0.01::DOUBLE) / NULLIF(dn, 0)')} AS sortino, {R4('-c / NULLIF(dd, 0)')} AS calmar, {R4('best')} AS best, {R4('worst')} AS worst FROM m")
def metrics_ext(p):
    m = B.metrics(B.curve(nets(p)))
    return m.select(*[r4(F.col(c)).alias(c) for c in ("sharpe", "sortino", "calmar", "best", "worst")])


@query("underwater", CURVE + ", g AS (SELECT *, SUM(CASE WHEN drawdown >= 0 THEN 1 ELSE 0 END) OVER (ORDER BY i) AS g FROM curve), r AS (SELECT COUNT(*) AS n FROM g WHERE drawdown < 0 GROUP BY g) SELECT MAX(n) AS longest FROM r")
def underwater(p):
    return B.underwater(B.curve(nets(p)))


@query("honest_run", HELD + f", {_ERA_SQL}, dates AS (SELECT DISTINCT i, d FROM coh), e AS (SELECT era, net FROM nets JOIN dates USING (i) JOIN eras ON d BETWEEN a AND z) SELECT era, COUNT(*) AS n, {R4('POW(EXP(SUM(LN(1 + net))), 12.0::DOUBLE / COUNT(*)) - 1')} AS cagr, {R4('STDDEV_SAMP(net) * SQRT(12)')} AS vol, {R4('AVG((net > 0)::INT)')} AS win FROM e GROUP BY era")
def honest_run(p):
    c = cohorts(p)
    rows = B.held_returns(c).join(c.select("i", "d").distinct(), "i").join(eras(p), F.expr("d BETWEEN a AND z"))
    m = B.metrics(B.curve(rows, "i", "net", "era"), "net", 12.0, "era")
    return m.select("era", "n", *[r4(F.col(c)).alias(c) for c in ("cagr", "vol", "win")])


@query("overlay", HELD + f""", x AS (SELECT i, net, CASE WHEN AVG(net) OVER (ORDER BY i ROWS 2 PRECEDING) > 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS e FROM nets), h AS (SELECT *, COALESCE(LAG(e) OVER (ORDER BY i), e) AS held FROM x), y AS (SELECT *, ABS(held - COALESCE(LAG(held) OVER (ORDER BY i), 0)) AS ch FROM h)
    SELECT i, held, {R4("held * net + (1 - held) * 0 - ch * 0.00285::DOUBLE")} AS overlay FROM y""")  # fmt: skip
def overlay(p):
    e = F.when(F.avg("net").over(Window.partitionBy().orderBy("i").rowsBetween(-2, 0)) > 0, 1.0).otherwise(0.5)
    return B.overlaid(nets(p), e).select("i", "held", r4(F.col("overlay")).alias("overlay"))


@query("mn_curve", SCORED + f", s AS (SELECT d, AVG(fwd) FILTER (rating IN ('SUPER', 'STRONG')) / 100 / 3 - AVG(fwd) FILTER (rating = 'AVOID') / 100 / 3 AS net FROM scored GROUP BY d) SELECT d, {R4('EXP(SUM(LN(1 + net)) OVER (ORDER BY d))')} AS equity FROM s WHERE net IS NOT NULL")
def mn_curve(p):
    of = lambda *r: F.avg(F.when(F.col("rating").isin(*r), F.col("fwd"))) / 100 / 3
    s = scored(p).groupBy("d").agg((of("SUPER", "STRONG") - of("AVOID")).alias("net")).where("net IS NOT NULL")
    return B.curve(s, "d").select("d", r4(F.col("equity")).alias("equity"))


@query("bt_records", SCORED + f" SELECT id, d, rating, {R4('fwd')} AS fwd, fwd > 0 AS win FROM scored WHERE fwd IS NOT NULL")
def bt_records(p):
    return scored(p).where("fwd IS NOT NULL").select("id", "d", "rating", r4(F.col("fwd")).alias("fwd"), (F.col("fwd") > 0).alias("win"))


@query("cycle", SCORED + f", {_ERA_SQL}, s AS (SELECT era, d, AVG(fwd) FILTER (rating IN ('SUPER', 'STRONG')) - AVG(fwd) FILTER (rating = 'AVOID') AS x FROM scored JOIN eras ON d BETWEEN a AND z GROUP BY ALL) SELECT era, COUNT(x) AS days, {R4('AVG(x)')} AS mean, {R4('CASE WHEN COUNT(x) >= 3 AND STDDEV_SAMP(x) > 0 THEN AVG(x) / STDDEV_SAMP(x) * SQRT(COUNT(x)) END')} AS t FROM s WHERE x IS NOT NULL GROUP BY era")
def cycle(p):
    of = lambda *r: F.avg(F.when(F.col("rating").isin(*r), F.col("fwd")))
    s = scored(p).join(eras(p), F.expr("d BETWEEN a AND z")).groupBy("era", "d").agg((of("SUPER", "STRONG") - of("AVOID")).alias("x")).where("x IS NOT NULL")
    return s.groupBy("era").agg(F.count("x").alias("days"), r4(F.avg("x")).alias("mean"), r4(X.t_stat("x")).alias("t"))


@query("grid_search", SCORED + f", g AS (SELECT c2, fwd, lo, hi_ FROM scored CROSS JOIN (VALUES (50), (60), (70)) a(lo) CROSS JOIN (VALUES (30), (40)) b(hi_) WHERE fwd IS NOT NULL) SELECT lo, hi_ AS cut, {R4('AVG(fwd) FILTER (c2 >= lo) - AVG(fwd) FILTER (c2 < hi_)')} AS spread, COUNT(*) FILTER (c2 >= lo) AS n FROM g GROUP BY ALL")
def grid_search(p):
    grid = F.explode(F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("cut")) for a in (50, 60, 70) for b in (30, 40)]))
    g = scored(p).where("fwd IS NOT NULL").select("c2", "fwd", grid.alias("g")).select("c2", "fwd", "g.*")
    of = lambda cond: F.avg(F.when(F.expr(cond), F.col("fwd")))
    return g.groupBy("lo", "cut").agg(r4(of("c2 >= lo") - of("c2 < cut")).alias("spread"), F.count_if(F.expr("c2 >= lo")).alias("n"))


@query("switch_cmp", SCORED + f", b AS (SELECT d, AVG(mom) > 0 AS up FROM scored WHERE mom IS NOT NULL GROUP BY d), s AS (SELECT d, fwd, CASE WHEN up THEN pm ELSE c2 END AS k FROM scored JOIN b USING (d)), q AS (SELECT *, QUANTILE_CONT(k, 0.8) OVER (PARTITION BY d) AS cut FROM s WHERE k IS NOT NULL) SELECT d, {R4('AVG(fwd)')} AS fwd, COUNT(*) AS n FROM q WHERE k >= cut GROUP BY d")
def switch_cmp(p):
    s = scored(p)
    up = s.where("mom IS NOT NULL").groupBy("d").agg((F.avg("mom") > 0).alias("up"))
    k = s.join(up, "d").withColumn("k", F.when(F.col("up"), F.col("pm")).otherwise(F.col("c2"))).where("k IS NOT NULL")
    cut = k.groupBy("d").agg(F.percentile("k", 0.8).alias("cut"))
    return k.join(cut, "d").where("k >= cut").groupBy("d").agg(r4(F.avg("fwd")).alias("fwd"), F.count("*").alias("n"))


@query("reweight", OBS + f", {ic_sql('mom', name='i1')}, {ic_sql('hi', name='i2')}, w AS (SELECT (SELECT AVG(ic) FROM i1 WHERE d < DATE '1999-01-01' AND NOT ISNAN(ic)) AS a, (SELECT AVG(ic) FROM i2 WHERE d < DATE '1999-01-01' AND NOT ISNAN(ic)) AS b) SELECT {R4('GREATEST(a, 0) / NULLIF(GREATEST(a, 0) + GREATEST(b, 0), 0)')} AS mom, {R4('GREATEST(b, 0) / NULLIF(GREATEST(a, 0) + GREATEST(b, 0), 0)')} AS hi FROM w")
def reweight(p):
    long = observations(p).where("d < DATE '1999-01-01'").select("id", "d", "fwd", "mom", "hi").unpivot(["id", "d", "fwd"], ["mom", "hi"], "factor", "v")
    w = finite(X.rank_ic(long, "v", "fwd", "factor", "d")).groupBy("factor").agg(F.greatest(F.avg("ic"), F.lit(0.0)).alias("w"))
    both = w.agg(F.max(F.when(F.col("factor") == "mom", F.col("w"))).alias("a"), F.max(F.when(F.col("factor") == "hi", F.col("w"))).alias("b"))
    total = F.nullif(F.col("a") + F.col("b"), F.lit(0.0))
    return both.select(r4(F.col("a") / total).alias("mom"), r4(F.col("b") / total).alias("hi"))


# --- trades ---

_ENTRY = f", v AS (SELECT id, d, t, close, close / LAG(close) OVER (PARTITION BY id ORDER BY d) - 1 AS r FROM sbars), s AS (SELECT *, {roll('STDDEV_SAMP', 'r', 60, 20)} * 100 AS sd, {roll('MIN', 'close', 20, 1)} AS lo FROM v), ent AS MATERIALIZED (SELECT id, t AS t0, d AS d0, close AS close0, lo * 0.97::DOUBLE AS support, LEAST(2.5::DOUBLE * sd, 15::DOUBLE) AS buffer FROM s WHERE sd IS NOT NULL)"


def entries(p, with_band=None):
    """An entry at every bar whose deviation is known, with the column that with_band adds to bars."""
    rows = (with_band(p.sbars) if with_band else p.sbars).withColumn("r", S.change("close"))
    rows = rows.withColumns({"sd": S.std("r", 60, 20) * 100, "lo": S.lowest("close", 20, 1)}).where("sd IS NOT NULL")
    return rows.select("id", F.col("t").alias("t0"), F.col("close").alias("close0"), (F.col("lo") * 0.97).alias("support"), F.least(F.col("sd") * 2.5, F.lit(15.0)).alias("buffer"), *["band"] * bool(with_band))


_EXITS = f""", nx AS (SELECT id, t, close, LEAD(open) OVER (PARTITION BY id ORDER BY t) AS nxt FROM sbars), pth AS (SELECT e.*, n.t, n.close, COALESCE(n.nxt, n.close) AS fill, GREATEST(close0, MAX(n.close) OVER (PARTITION BY e.id, t0 ORDER BY n.t)) AS peak FROM ent e JOIN nx n ON n.id = e.id AND n.t > t0 AND n.t <= t0 + 20),
    h AS (SELECT *, CASE WHEN close < support THEN 'support' WHEN close < peak * (1 - buffer / 100) THEN 'trailing' END AS reason FROM pth), f AS (SELECT id, t0, close0, t, reason, fill, ROW_NUMBER() OVER (PARTITION BY id, t0 ORDER BY (reason IS NULL), CASE WHEN reason IS NULL THEN -t ELSE t END) AS k, close FROM h)
    SELECT id, t0, t, COALESCE(reason, 'time') AS reason, {R4("CASE WHEN reason IS NULL THEN close ELSE fill END / close0 - 1")} AS ret FROM f WHERE k = 1"""


@query("exit_trailing", _ENTRY + _EXITS)
def exit_trailing(p):
    p = dealt(p)
    return B.exits(entries(p), p.sbars).select("id", "t0", "t", "reason", r4(F.col("ret")).alias("ret"))


@query("lag_excess", OBS + f", k AS (SELECT id, t, d FROM obs), n AS (SELECT id, t, LEAD(close, 21) OVER w / LEAD(close, 1) OVER w - 1 AS lagged, LEAD(close, 20) OVER w / close - 1 AS now FROM sbars WINDOW w AS (PARTITION BY id ORDER BY d)) SELECT d, {R4('AVG(now) * 100')} AS now, {R4('AVG(lagged) * 100')} AS lagged FROM k JOIN n USING (id, t) WHERE now IS NOT NULL AND lagged IS NOT NULL GROUP BY d")
def lag_excess(p):
    n = p.sbars.select("id", "t", (S.lead("close", 21) / S.lead("close", 1) - 1).alias("lagged"), (S.lead("close", 20) / F.col("close") - 1).alias("now")).where("now IS NOT NULL AND lagged IS NOT NULL")
    return observations(p).select("id", "t", "d").join(n, ["id", "t"]).groupBy("d").agg(r4(F.avg("now") * 100).alias("now"), r4(F.avg("lagged") * 100).alias("lagged"))


@query("batch_entry", f", n AS (SELECT id, d, close, (LEAD(open, 1) OVER w + LEAD(open, 4) OVER w + LEAD(open, 7) OVER w) / 3 AS entry, LEAD(close, 27) OVER w AS out_ FROM sbars WINDOW w AS (PARTITION BY id ORDER BY d)) SELECT id, d, {R4('out_ / entry - 1')} AS ret FROM n WHERE entry IS NOT NULL AND out_ IS NOT NULL")
def batch_entry(p):
    n = p.sbars.select("id", "d", ((S.lead("open", 1) + S.lead("open", 4) + S.lead("open", 7)) / 3).alias("entry"), S.lead("close", 27).alias("out_")).where("entry IS NOT NULL AND out_ IS NOT NULL")
    return n.select("id", "d", r4(F.col("out_") / F.col("entry") - 1).alias("ret"))


@query("cadence", COHORT + f", ks(k) AS (VALUES (1), (2), (3)), h AS (SELECT k, i, id, fwd FROM coh, ks WHERE (i - 1) % k = 0) SELECT a.k, COUNT(DISTINCT a.i) AS rebalances, {R4('AVG(a.fwd)')} AS fwd, {R4('1 - COUNT(b.id)::DOUBLE / COUNT(*)')} AS turnover FROM h a LEFT JOIN h b ON b.k = a.k AND b.i = a.i - a.k AND b.id = a.id GROUP BY a.k")
def cadence(p):
    h = cohorts(p).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).where("(i - 1) % k = 0").select("k", "i", "id", "fwd")
    before = h.select("k", (F.col("i") + F.col("k")).alias("i"), "id", F.lit(1).alias("kept"))
    return h.join(before, ["k", "i", "id"], "left").groupBy("k").agg(F.countDistinct("i").alias("rebalances"), r4(F.avg("fwd")).alias("fwd"), r4(1 - F.count("kept").cast("double") / F.count("*")).alias("turnover"))


@query("action_card", SCORED + f", g AS (SELECT QUANTILE_CONT(gap, 0.1) AS lo, QUANTILE_CONT(gap, 0.9) AS hi FROM (SELECT close / LAG(close) OVER (PARTITION BY id ORDER BY d) - 1 AS gap FROM sbars)), t AS (SELECT id, d, close, ROW_NUMBER() OVER (ORDER BY c2 DESC, id) AS place FROM scored WHERE d = (SELECT MAX(d) FROM scored)) SELECT place, id, {R4('close * (1 + lo)', 2)} AS buy_low, {R4('close * (1 + hi)', 2)} AS buy_high FROM t, g WHERE place <= 8")
def action_card(p):
    gap = quantiles(p.sbars.select(S.change("close").alias("g")), "g", {"g_lo": 0.1, "g_hi": 0.9}, 0.0005)
    s = scored(p)
    s = s.join(F.broadcast(s.agg(F.max("d").alias("_last"))), F.col("d") == F.col("_last"))
    top = s.withColumn("place", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("c2"), "id"))).where("place <= 8")
    return top.join(F.broadcast(gap)).select("place", "id", r4(F.col("close") * (1 + F.col("g_lo")), 2).alias("buy_low"), r4(F.col("close") * (1 + F.col("g_hi")), 2).alias("buy_high"))


@query("track_curve", COHORT + f", x AS (SELECT a.i, a.id, b.close / a.close - 1 AS r FROM (SELECT coh.i, coh.id, s.close FROM coh JOIN scored s ON s.id = coh.id AND s.d = coh.d) a JOIN (SELECT cal.i, id, close FROM scored JOIN cal USING (d)) b ON b.id = a.id AND b.i = a.i + 1), m AS (SELECT i, AVG(r) AS r FROM x GROUP BY i) SELECT i, {R4('r')} AS r, {R4('EXP(SUM(LN(1 + r)) OVER (ORDER BY i))')} AS equity FROM m")
def track_curve(p):
    c, s = cohorts(p), scored(p).select("id", "d", "close")
    cal = s.select("d").distinct().withColumn("i", F.row_number().over(Window.partitionBy().orderBy("d")))
    later = s.join(F.broadcast(cal), "d").select("id", (F.col("i") - 1).alias("i"), F.col("close").alias("next"))
    r = c.select("i", "d", "id").join(s, ["id", "d"]).join(later, ["id", "i"]).groupBy("i").agg(F.avg(F.col("next") / F.col("close") - 1).alias("net"))
    return B.curve(r).select("i", r4(F.col("net")).alias("r"), r4(F.col("equity")).alias("equity"))


@query("fills_pnl", f", f AS (SELECT id, d, close, volume, LEAD(close, 10) OVER (PARTITION BY id ORDER BY d) AS sell FROM sbars) SELECT id, d, {R4('(sell - close) * volume - GREATEST(close * volume * 0.0006::DOUBLE, 1) - GREATEST(sell * volume * 0.0006::DOUBLE, 1) - sell * volume * 0.003::DOUBLE', 2)} AS pnl FROM f WHERE sell IS NOT NULL")
def fills_pnl(p):
    """A fill at every bar, sold 10 bars later."""
    return fills(p.sbars)


def fills(bars):
    f = bars.select("id", "d", "close", "volume", S.lead("close", 10).alias("sell")).where("sell IS NOT NULL")
    fee = lambda v: F.greatest(v * 0.0006, F.lit(1.0))
    pnl = (F.col("sell") - F.col("close")) * F.col("volume") - fee(F.col("close") * F.col("volume")) - fee(F.col("sell") * F.col("volume")) - F.col("sell") * F.col("volume") * 0.003
    return f.select("id", "d", r4(pnl, 2).alias("pnl"))


@query("bench_stats", _EW + f" SELECT COUNT(*) AS n, {R4('POW(EXP(SUM(LN(1 + ret))) * (1 - 0.001425::DOUBLE), 252.0::DOUBLE / COUNT(*)) - 1')} AS cagr, {R4('STDDEV_SAMP(ret) * SQRT(252)')} AS vol FROM idx")
def bench_stats(p):
    i = ew_index(p)
    n = F.count("*")
    return i.agg(n.alias("n"), r4(F.pow(F.exp(F.sum(F.ln(1 + F.col("ret")))) * (1 - 0.001425), 252.0 / n) - 1).alias("cagr"), r4(F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol"))


@query("dca", CURVE + f", g AS (SELECT i, equity, COALESCE(LAG(equity) OVER (ORDER BY i), 1) AS start FROM curve) SELECT i, COUNT(*) OVER (ORDER BY i)::DOUBLE AS paid, {R4('equity * SUM(1 / start) OVER (ORDER BY i)')} AS worth FROM g")
def dca(p):
    return B.contributed(nets(p)).select("i", "paid", r4(F.col("worth")).alias("worth"))


@query("mwrr")
def mwrr(p):
    d = B.contributed(nets(p))
    last = d.agg(F.max("i").alias("l"), F.max_by("worth", "i").alias("w"))
    flows = d.select(F.lit("all").alias("who"), F.col("i").cast("double").alias("i"), F.lit(-1.0).alias("flow")).unionByName(last.select(F.lit("all").alias("who"), (F.col("l") + 1).cast("double").alias("i"), F.col("w").alias("flow")))
    return B.money_weighted(flows, "who")


@query("bootstrap")
def bootstrap(p):
    return B.bootstrap(nets(p))


@query("basket_sim")
def basket_sim(p):
    return B.random_baskets(scored(p).where("fwd IS NOT NULL"), "d", "id", "fwd", 8, 50)


@query("non_overlap", ", src AS (SELECT id, t FROM sbars WHERE volume > 40), w AS (SELECT id, list(t ORDER BY t) AS ts FROM src GROUP BY id), f AS (SELECT id, list_reduce(list_transform(ts, lambda x: [x]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= 20 THEN list_concat(acc, x) ELSE acc END) AS k FROM w) SELECT id, UNNEST(k)::BIGINT AS t FROM f")
def non_overlap(p):
    return B.spaced(p.sbars.where("volume > 40").select("id", "t"), "id", "t", 20)


@query("basket_build", SCORED + f", vol AS (SELECT id, d, {roll('STDDEV_SAMP', 'r', 60, 20)} AS v FROM (SELECT id, d, close / LAG(close) OVER (PARTITION BY id ORDER BY d) - 1 AS r FROM sbars)), b AS (SELECT s.d, s.id, s.industry, vol.v, ROW_NUMBER() OVER (PARTITION BY s.d ORDER BY c2 DESC, s.id) AS k FROM scored s JOIN vol ON vol.id = s.id AND vol.d = s.d) SELECT d, id, DENSE_RANK() OVER (PARTITION BY d ORDER BY industry) AS code, COALESCE(v <= MEDIAN(v) OVER (PARTITION BY d), false) AS calm FROM b WHERE k <= 10")
def basket_build(p):
    vol = p.sbars.withColumn("r", S.change("close")).select("id", "d", S.std("r", 60, 20).alias("v"))
    top = scored(p).withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("c2"), "id"))).join(vol, ["id", "d"]).where("k <= 10")
    by = Window.partitionBy("d")
    return top.select("d", "id", F.dense_rank().over(by.orderBy("industry")).alias("code"), F.coalesce(F.col("v") <= F.median("v").over(by), F.lit(False)).alias("calm"))
