"""Flow, ownership, revenue and statement features, and the scores built from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores as R
from tidemark.functions.numeric import ratio
from tidemark.operators import flow as C
from tidemark.operators.windows import Series, latest_row

from .base import R4, query, r4
from .factors import SCORED, scored
from .technicals import roll

S = Series()
P = "PARTITION BY id ORDER BY d"


@query("flow_streak", f""", i AS (SELECT *, ROW_NUMBER() OVER ({P}) AS i FROM flow)
    SELECT id, d, i - COALESCE(MAX(CASE WHEN fnet <= 0 THEN i END) OVER ({P} ROWS UNBOUNDED PRECEDING), 0) AS buy_days, i - COALESCE(MAX(CASE WHEN fnet >= 0 THEN i END) OVER ({P} ROWS UNBOUNDED PRECEDING), 0) AS sell_days FROM i""")  # fmt: skip
def flow_streak(p):
    return C.streaks(p.flow, "fnet").select("id", "d", "buy_days", "sell_days")


@query("net_flow_n", "SELECT id, SUM(fnet)::BIGINT AS net, SUM(ABS(fnet))::BIGINT AS gross FROM (SELECT *, DENSE_RANK() OVER (PARTITION BY id ORDER BY d DESC) AS k FROM flow) WHERE k <= 10 GROUP BY id")
def net_flow_n(p):
    return C.net_over(p.flow, "fnet", 10)


def _s(v, k):
    return f"(SUM({v}) OVER ({P} ROWS {k - 1} PRECEDING))::DOUBLE"


@query("participation", f"SELECT id, d, {R4(f'{_s("ABS(fnet) + ABS(tnet)", 10)} / NULLIF(2 * {_s("volume", 10)}, 0) * 100')} AS participation, {R4(f'CASE WHEN {_s("fnet + tnet", 20)} <= 0 AND {_s("fnet + tnet", 5)} > 0 THEN 2 ELSE {_s("fnet + tnet", 5)} / NULLIF({_s("fnet + tnet", 20)}, 0) END')} AS flow_accel FROM flow")
def participation(p):
    of = lambda v, k: F.sum(F.expr(v)).over(S.last(k))
    short, long = of("fnet + tnet", 5), of("fnet + tnet", 20)
    accel = F.when((long <= 0) & (short > 0), 2.0).otherwise(ratio(short, long))
    return p.flow.select("id", "d", r4(ratio(of("ABS(fnet) + ABS(tnet)", 10), 2 * of("volume", 10)) * 100).alias("participation"), r4(accel).alias("flow_accel"))


@query("net_ratio_map", "SELECT id, d, " + ", ".join(R4(f"{_s('fnet', k)} / NULLIF({_s('volume', k)}, 0)") + f" AS f{k}" for k in C.HORIZONS) + " FROM flow")
def net_ratio_map(p):
    m = p.flow.select("id", "d", C.horizon_ratios("fnet").alias("m"))
    return m.select("id", "d", *[r4(F.element_at("m", F.lit(k))).alias(f"f{k}") for k in C.HORIZONS])


@query("whale_conc", f", h AS (SELECT id, q, known_date, value FROM stmt WHERE type = 'gross') SELECT f.id, f.d, {R4(f'net20 / NULLIF(h.value::DOUBLE / 100000, 0) * 100')} AS concentration FROM (SELECT id, d, {_s('tnet', 20)} AS net20 FROM flow) f ASOF LEFT JOIN h ON h.id = f.id AND f.d >= h.known_date")
def whale_conc(p):
    from tidemark.operators.asof import asof_join

    f = p.flow.select("id", "d", F.sum("tnet").over(S.last(20)).cast("double").alias("net20"))
    met = asof_join(f, p.stmt.where("type = 'gross'").drop("type"), ["id"], "d", "known_date")
    return met.select("id", "d", r4(F.col("net20") / F.nullif(F.col("value").cast("double") / 100000, F.lit(0.0)) * 100).alias("concentration"))


@query("chip_windows", "SELECT id, d, " + ", ".join(R4(f"{_s('fnet', k)} / NULLIF({_s('volume', k)}, 0) * 100") + f" AS chip{k}" for k in (5, 10, 20, 60)) + " FROM flow")
def chip_windows(p):
    return p.flow.select("id", "d", *[r4(ratio(F.sum("fnet").over(S.last(k)), F.sum("volume").over(S.last(k))) * 100).alias(f"chip{k}") for k in (5, 10, 20, 60)])


@query("flow_state", f", s AS (SELECT id, d, SUM(fnet) OVER ({P} ROWS 19 PRECEDING) AS l, SUM(fnet) OVER ({P} ROWS 2 PRECEDING) AS s FROM flow) SELECT id, d, CASE WHEN l > 0 THEN 'in' WHEN l < 0 THEN 'out' END || '_' || CASE WHEN s > 0 THEN 'in' WHEN s < 0 THEN 'out' END AS state FROM s")
def flow_state(p):
    return p.flow.select("id", "d", C.flow_state(F.sum("fnet").over(S.last(20)), F.sum("fnet").over(S.last(3))).alias("state"))


@query("holder_dist", f", l AS (SELECT l_suppkey AS id, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS m, (SUM(l_quantity) FILTER (l_quantity >= 40))::DOUBLE AS big, SUM(l_quantity)::DOUBLE AS total FROM lineitem GROUP BY ALL), r AS (SELECT id, m, COALESCE(big, 0) / total * 100 AS big FROM l) SELECT id, m, {R4('big')} AS big, {R4('big - LAG(big) OVER (PARTITION BY id ORDER BY m)')} AS change FROM r")
def holder_dist(p):
    l = p.table("lineitem").groupBy(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "month").alias("m")).agg((F.sum(F.when(F.col("l_quantity") >= 40, F.col("l_quantity")).otherwise(0)) / F.sum("l_quantity") * 100).alias("big"))
    return l.select("id", "m", r4(F.col("big")).alias("big"), r4(F.col("big") - F.lag("big").over(Window.partitionBy("id").orderBy("m"))).alias("change"))


@query("lag_features", "SELECT id, m, revenue - LAG(revenue, 1) OVER w AS d1, revenue - LAG(revenue, 3) OVER w AS d3, revenue - LAG(revenue, 12) OVER w AS d12 FROM revm WINDOW w AS (PARTITION BY id ORDER BY m)")
def lag_features(p):
    s = Series("id", "m")
    return p.revm.select("id", "m", *[(F.col("revenue") - s.lag("revenue", k)).alias(f"d{k}") for k in (1, 3, 12)])


@query("margin_chg", f"SELECT id, d, {R4('(cents::DOUBLE / COALESCE(LAG(cents, 10) OVER w, FIRST_VALUE(cents) OVER w)::DOUBLE - 1) * 100')} AS chg FROM bars WINDOW w AS (PARTITION BY id ORDER BY d)")
def margin_chg(p):
    base = F.coalesce(S.lag("cents", 10), F.first("cents").over(S.past))
    return p.bars.select("id", "d", r4((F.col("cents").cast("double") / base.cast("double") - 1) * 100).alias("chg"))


REV = f""", ry AS (SELECT id, m, revenue, SUM(revenue) OVER (PARTITION BY id, YEAR(m) ORDER BY m) AS ytd FROM revm), rj AS (SELECT a.id, a.m, a.revenue, a.revenue::DOUBLE / NULLIF(b.revenue, 0)::DOUBLE - 1::DOUBLE AS yoy, a.ytd::DOUBLE / NULLIF(b.ytd, 0)::DOUBLE - 1::DOUBLE AS ytd_yoy FROM ry a LEFT JOIN ry b ON b.id = a.id AND b.m = a.m - INTERVAL 1 YEAR),
    rm AS (SELECT *, ROW_NUMBER() OVER w AS i, revenue::DOUBLE / NULLIF(LAG(revenue) OVER w, 0)::DOUBLE - 1::DOUBLE AS mom, CASE WHEN COUNT(yoy) OVER a = 3 THEN AVG(yoy) OVER a END - CASE WHEN COUNT(yoy) OVER b = 3 THEN AVG(yoy) OVER b END AS accel, AVG(revenue) OVER a AS smooth, CASE WHEN COUNT(*) OVER y = 12 THEN SUM(revenue) OVER y END AS ttm
        FROM rj WINDOW w AS (PARTITION BY id ORDER BY m), a AS (PARTITION BY id ORDER BY m ROWS 2 PRECEDING), b AS (PARTITION BY id ORDER BY m ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING), y AS (PARTITION BY id ORDER BY m ROWS 11 PRECEDING)),
    mom_ AS (SELECT *, i - COALESCE(MAX(CASE WHEN NOT COALESCE(yoy > 0, false) THEN i END) OVER (PARTITION BY id ORDER BY m ROWS UNBOUNDED PRECEDING), 0) AS streak FROM rm)"""


@query("rev_momentum", REV + f" SELECT id, m, revenue, {R4('yoy')} AS yoy, {R4('mom')} AS mom, {R4('ytd_yoy')} AS ytd_yoy, {R4('accel')} AS accel, streak, {R4('smooth', 1)} AS smooth, ttm::BIGINT AS ttm FROM mom_")
def rev_momentum(p):
    r = C.revenue_momentum(p.revm)
    return r.select("id", "m", "revenue", *[r4(F.col(c)).alias(c) for c in ("yoy", "mom", "ytd_yoy", "accel")], "streak", r4(F.col("smooth"), 1).alias("smooth"), "ttm")


@query("rev_accel", REV + f" SELECT id, m, {R4('yoy - AVG(yoy) OVER (PARTITION BY id ORDER BY m ROWS 2 PRECEDING)')} AS rev_accel FROM mom_")
def rev_accel(p):
    s = Series("id", "m")
    return C.revenue_momentum(p.revm).select("id", "m", r4(F.col("yoy") - F.avg("yoy").over(s.last(3))).alias("rev_accel"))


WIDE = ", wide AS (SELECT id, q, ANY_VALUE(known_date) AS known_date, SUM(value) FILTER (type = 'gross')::BIGINT AS gross, SUM(value) FILTER (type = 'cost')::BIGINT AS cost FROM stmt GROUP BY id, q)"


def wide(p):
    return p.stmt.groupBy("id", "q", "known_date").pivot("type", ["gross", "cost"]).agg(F.sum("value"))


@query("ratios", WIDE + f" SELECT id, q, {R4('(COALESCE(gross, 0) - COALESCE(cost, 0))::DOUBLE / NULLIF(gross, 0)::DOUBLE * 100')} AS margin, {R4('COALESCE(cost, 0)::DOUBLE / NULLIF(COALESCE(gross, 0) + COALESCE(cost, 0), 0)::DOUBLE * 100')} AS debt, {R4('gross::DOUBLE / NULLIF(cost, 0)::DOUBLE * 100')} AS current FROM wide")
def ratios(p):
    g, c = F.coalesce("gross", F.lit(0)), F.coalesce("cost", F.lit(0))
    return wide(p).select("id", "q", r4(ratio(g - c, F.col("gross")) * 100).alias("margin"), r4(ratio(c, g + c) * 100).alias("debt"), r4(ratio("gross", "cost") * 100).alias("current"))


@query("gm_trend", WIDE + f", g AS (SELECT id, q, (gross - cost)::DOUBLE / NULLIF(gross, 0)::DOUBLE * 100 AS gm FROM wide) SELECT id, q, {R4('gm - AVG(gm) OVER (PARTITION BY id ORDER BY q ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS trend FROM g")
def gm_trend(p):
    g = wide(p).select("id", "q", (ratio(F.col("gross") - F.col("cost"), F.col("gross")) * 100).alias("gm"))
    return g.select("id", "q", r4(F.col("gm") - F.avg("gm").over(Window.partitionBy("id").orderBy("q").rowsBetween(-3, -1))).alias("trend"))


@query("eps_pos_q4", WIDE + " SELECT id, q, CASE WHEN COUNT(*) OVER w >= 4 THEN SUM((COALESCE(gross, 0) > COALESCE(cost, 0))::INT) OVER w END::BIGINT AS positive FROM wide WINDOW w AS (PARTITION BY id ORDER BY q ROWS 3 PRECEDING)")
def eps_pos_q4(p):
    w = Window.partitionBy("id").orderBy("q").rowsBetween(-3, 0)
    up = (F.coalesce("gross", F.lit(0)) > F.coalesce("cost", F.lit(0))).cast("int")
    return wide(p).select("id", "q", F.when(F.count("*").over(w) >= 4, F.sum(up).over(w)).alias("positive"))


@query("confidence", WIDE + " SELECT id, q, COALESCE(gross, 0) AS gross, COALESCE(cost, 0) AS cost, 100 - 8.0::DOUBLE * ((gross IS NULL)::INT + (cost IS NULL)::INT) AS confidence, CONCAT_WS('+', CASE WHEN gross IS NULL THEN 'gross' END, CASE WHEN cost IS NULL THEN 'cost' END) AS gaps FROM wide")
def confidence(p):
    return C.with_fallbacks(wide(p), {"gross": 0, "cost": 0}).select("id", "q", "gross", "cost", "confidence", F.concat_ws("+", "missing").alias("gaps"))


@query("price_sales", REV + f", b AS (SELECT id, d, close FROM sbars QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) = 1), t AS (SELECT id, ARG_MAX(ttm, m) AS ttm FROM mom_ WHERE ttm IS NOT NULL GROUP BY id) SELECT b.id, {R4('COALESCE(close * 1e9::DOUBLE / NULLIF(ttm, 0)::DOUBLE, 20 * 0.5::DOUBLE)')} AS ps FROM b LEFT JOIN t USING (id)")
def price_sales(p):
    t = C.revenue_momentum(p.revm).where("ttm IS NOT NULL").groupBy("id").agg(F.max_by("ttm", "m").alias("ttm"))
    b = latest_row(p.sbars.select("id", "d", "close"), ["id"], F.desc("d"))
    return b.join(t, "id", "left").select("id", r4(F.coalesce(ratio(F.col("close") * 1e9, F.col("ttm")), F.lit(10.0))).alias("ps"))


@query("cash_health", WIDE + " SELECT id, q, CASE WHEN gross - cost IS NULL THEN 'unknown' WHEN gross - cost < 0 THEN 'high_risk' WHEN (gross - cost)::DOUBLE / NULLIF(gross, 0)::DOUBLE < 0.5 OR (gross - 2 * cost < 0 AND gross - cost <= 0) THEN 'watch' ELSE 'healthy' END AS cash FROM wide")
def cash_health(p):
    none = F.lit(None).cast("double")
    rows = wide(p).withColumns({"ocf": F.col("gross") - F.col("cost"), "fcf": F.col("gross") - 2 * F.col("cost"), "ocf_to_income": ratio(F.col("gross") - F.col("cost"), F.col("gross")), "cum_yoy": none, "rev_cagr": none})
    return rows.select("id", "q", R.cash_health().alias("cash"))


@query("profit_quality", REV + " SELECT id, m, CASE WHEN mom > 0 AND (mom - yoy) * 100 >= 25 THEN false WHEN mom < 0 AND yoy > 0 THEN true ELSE false END AS risk, CASE WHEN yoy * 100 >= 40 THEN 'strong' WHEN yoy * 100 >= 20 THEN 'medium' WHEN yoy IS NOT NULL THEN 'weak' ELSE 'unknown' END AS moat FROM mom_")
def profit_quality(p):
    r = C.revenue_momentum(p.revm).withColumns({"income_growth": F.col("mom") * 100, "revenue_growth": F.col("yoy") * 100, "operating_share": F.lit(None).cast("double"), "gross_margin": F.col("yoy") * 100})
    return r.select("id", "m", R.profit_risk().alias("risk"), R.moat().alias("moat"))


@query("valuation_score", SCORED + f""", v AS (SELECT id, d, 100 - pb AS pe_pct, pv AS pb_pct, bias + 40 AS pe, CASE WHEN mom > 0 THEN mom END AS growth FROM scored), g AS (SELECT *, CASE WHEN pe > 0 AND growth > 0 THEN pe / growth END AS peg FROM v),
    a AS (SELECT *, CASE WHEN peg <= 0.75 THEN 100 WHEN peg <= 1 THEN 100 - 20 * (peg - 0.75) / 0.25::DOUBLE WHEN peg <= 1.5 THEN 80 - 25 * (peg - 1) / 0.5::DOUBLE WHEN peg <= 2 THEN 55 - 20 * (peg - 1.5) / 0.5::DOUBLE WHEN peg <= 3 THEN 35 - 35 * (peg - 2) WHEN peg IS NOT NULL THEN 0 END AS a,
        CASE WHEN pe_pct IS NOT NULL OR pb_pct IS NOT NULL THEN (COALESCE(100 - pe_pct, 0) * 0.45::DOUBLE + COALESCE(100 - pb_pct, 0) * 0.3::DOUBLE) / (CASE WHEN pe_pct IS NULL THEN 0 ELSE 0.45::DOUBLE END + CASE WHEN pb_pct IS NULL THEN 0 ELSE 0.3::DOUBLE END) END AS b FROM g),
    x AS (SELECT *, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN a * 0.85::DOUBLE + b * 0.15::DOUBLE ELSE COALESCE(a, b) END AS mix, COALESCE(pe_pct >= 80, false) AND (peg IS NOT NULL OR growth IS NOT NULL) AND NOT COALESCE(peg < 1, false) AS bubble FROM a)
    SELECT id, d, {R4("CASE WHEN bubble THEN LEAST(mix, 30) ELSE mix END", 2)} AS score FROM x""")  # fmt: skip
def valuation_score(p):
    none = F.lit(None).cast("double")
    v = scored(p).withColumns({"pe_pct": 100 - F.col("pb"), "pb_pct": F.col("pv"), "yield_pct": none, "industry_pct": none, "pe": F.col("bias") + 40, "growth": F.when(F.col("mom") > 0, F.col("mom")), "cum_yoy": none})
    return v.select("id", "d", r4(R.valuation_score(), 2).alias("score"))


@query("sector", ", s AS (SELECT s_suppkey AS id, s_acctbal AS b, s_nationkey AS n FROM supplier) SELECT id, CASE WHEN id % 17 = 0 THEN 'A' WHEN n = 3 THEN 'A' WHEN b > 0 THEN CASE WHEN b * 3e7 >= 1e11 THEN 'A' WHEN b * 3e7 < 3e10 THEN 'B' WHEN n < 8 THEN 'B' ELSE 'A' END WHEN (CASE WHEN n >= 20 THEN 2 WHEN n >= 10 THEN 1 ELSE 0 END) - (CASE WHEN n < 8 THEN 2 ELSE 0 END) >= 2 THEN 'A' ELSE 'B' END AS sector FROM s")
def sector(p):
    s = p.table("supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") * 3e7).alias("market_cap"), F.col("s_nationkey").alias("n"))
    s = s.withColumns({"is_financial": F.col("n") == 3, "cyclical": F.col("n") < 8, "stable": F.lit(False), "atr_pct": F.lit(None).cast("double"), "foreign_share": F.when(F.col("n") >= 20, 40.0).when(F.col("n") >= 10, 25.0).otherwise(0.0)})
    return s.select("id", R.sector(F.when(F.col("id") % 17 == 0, "A")).alias("sector"))


@query("reason_line", SCORED + ", u AS (SELECT id, d, UNNEST([{'k': 'momentum', 'v': COALESCE(pm, 0)}, {'k': 'high', 'v': COALESCE(ph, 0)}, {'k': 'volume', 'v': COALESCE(pv, 0)}]) AS x FROM scored), r AS (SELECT id, d, x.k AS k, ROW_NUMBER() OVER (PARTITION BY id, d ORDER BY x.v DESC, x.k) AS n FROM u) SELECT id, d, STRING_AGG(k, '+' ORDER BY n) AS why FROM r WHERE n <= 2 GROUP BY ALL")
def reason_line(p):
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = F.array(*[F.struct((-zero(F.col(c))).alias("v"), F.lit(k).alias("k")) for k, c in (("momentum", "pm"), ("high", "ph"), ("volume", "pv"))])
    return scored(p).select("id", "d", F.array_join(F.slice(F.array_sort(parts), 1, 2)["k"], "+").alias("why"))


@query("pit_audit", f""", m AS (SELECT id, d, {roll("AVG", "close", 60)} AS ma60, {roll("STDDEV_SAMP", "close", 20)} AS sd FROM sbars) SELECT id, COUNT(*) AS n, COUNT(*) FILTER (ma60 IS NULL) AS dead_ma, COUNT(*) FILTER (sd = 0) AS flat FROM m GROUP BY id ORDER BY dead_ma::DOUBLE / n DESC, id LIMIT 12""")
def pit_audit(p):
    m = p.sbars.select("id", S.mean("close", 60).alias("ma60"), S.std("close", 20).alias("sd"))
    a = m.groupBy("id").agg(F.count("*").alias("n"), F.count_if(F.col("ma60").isNull()).alias("dead_ma"), F.count_if(F.col("sd") == 0).alias("flat"))
    return a.orderBy(F.desc(F.col("dead_ma").cast("double") / F.col("n")), "id").limit(12)
