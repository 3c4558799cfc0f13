"""Supplementary queries: variants, upserts of tracking rows, contributions against a benchmark, advice lines, full exits and profiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores as R
from tidemark.operators import factors as X
from tidemark.operators import portfolio as B
from tidemark.operators import regime as K
from tidemark.operators import technical as T
from tidemark.operators.asof import asof_join
from tidemark.operators.windows import Series, latest_row
from tidemark.sources import store

from .base import R4, dealt, query, r4
from .factors import SCORED, cohorts, scored
from .portfolios import _ENTRY, _EXITS, HELD, REGIME, entries, nets
from .snapshot import _ENDS, DIMS, FEATURES, MOMENTUM, RATED, TECHNICAL, dimensions, month_ends, rated, statement_facts
from .technicals import _TR, P, roll

S = Series()


@query("tstat", f", r AS (SELECT id, close / LAG(close) OVER (PARTITION BY id ORDER BY d) - 1 AS r FROM sbars) SELECT id, COUNT(r) AS n, {R4('CASE WHEN COUNT(r) >= 3 AND STDDEV_SAMP(r) > 0 THEN AVG(r) / STDDEV_SAMP(r) * SQRT(COUNT(r)) END')} AS t FROM r GROUP BY id")
def tstat(p):
    return p.sbars.select("id", S.change("close").alias("r")).groupBy("id").agg(F.count("r").alias("n"), r4(X.t_stat("r")).alias("t"))


@query("track_upsert", SCORED + ", old AS (SELECT d, id, rating, 0 AS src FROM scored WHERE d < DATE '1999-01-01'), new AS (SELECT d, id, 'SEEN' AS rating, 1 AS src FROM scored WHERE d >= DATE '1998-10-01'), b AS (SELECT * FROM old UNION ALL SELECT * FROM new) SELECT d, id, rating FROM b QUALIFY ROW_NUMBER() OVER (PARTITION BY d, id ORDER BY src DESC) = 1")
def track_upsert(p):
    s = scored(p).select("d", "id", "rating")
    return store.merge_by_priority(["d", "id"], s.where("d >= DATE '1998-10-01'").withColumn("rating", F.lit("SEEN")), s.where("d < DATE '1999-01-01'"))


def _spreads(name, rows):
    return f"{name} AS (SELECT variant, d, AVG(fwd) FILTER (r > n - FLOOR(n * 0.2::DOUBLE)) - AVG(fwd) FILTER (r <= FLOOR(n * 0.2::DOUBLE)) AS x FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY variant, d ORDER BY v, id) AS r, COUNT(*) OVER (PARTITION BY variant, d) AS n FROM ({rows}) WHERE v IS NOT NULL AND fwd IS NOT NULL) GROUP BY ALL)"


def spreads(long):
    s = X.tail_spread(long, "v", "fwd", "variant", "d")
    return s.groupBy("variant").agg(F.count("*").alias("days"), r4(F.avg("spread")).alias("mean"))


#: Shares of the growth-adjusted price in the valuation, in percent; the rest is the price's own history.
MIXES = (55, 70, 85, 100)
_FWD = ", fw AS (SELECT id, d, (LEAD(close, 20) OVER (PARTITION BY id ORDER BY d) / close - 1) * 100 AS fwd FROM sbars)"


@query("val_variants", DIMS + _FWD + ", " + _spreads("sp", f"SELECT w AS variant, d, id, fwd, FLOOR(CASE WHEN va IS NOT NULL AND vb IS NOT NULL THEN va * (w / 100.0::DOUBLE) + vb * (1 - w / 100.0::DOUBLE) ELSE COALESCE(va, vb) END * 1000000 + 0.5) AS v FROM dm JOIN fw USING (id, d), (VALUES {', '.join(f'({w})' for w in MIXES)}) m(w) WHERE {_ENDS}") + f" SELECT variant, COUNT(x) AS days, {R4('AVG(x)')} AS mean FROM sp WHERE x IS NOT NULL GROUP BY variant")
def val_variants(p):
    """Spread of the valuation by the share that the growth-adjusted price has in it."""
    rows = dimensions(p, month_ends(p)).withColumn("variant", F.explode(F.array(*map(F.lit, MIXES))))
    a = R.peg_score(F.when((F.col("pe") > 0) & (F.col("growth") > 0), F.col("pe") / F.col("growth")))
    b, w = R.history_score(), F.col("variant") / 100.0
    return spreads(rows.withColumn("v", F.floor(F.when(a.isNotNull() & b.isNotNull(), a * w + b * (1 - w)).otherwise(F.coalesce(a, b)) * 1000000 + 0.5)))


_RS = "CASE WHEN rs6 > 20 AND COALESCE(rs3, 0) > 0 THEN 8 WHEN rs6 > 8 THEN 5 WHEN rs6 > 0 THEN 2 WHEN rs6 < -15 THEN -6 WHEN rs6 < -5 THEN -3 ELSE 0 END"
VARIANTS = {
    "base": ("0", "0"), "no_relative_strength": ("0", f"-({_RS})"), "percent_b": ("CASE WHEN percent_b BETWEEN 0.5::DOUBLE AND 0.95::DOUBLE THEN 5 WHEN percent_b > 1.05::DOUBLE THEN -4 WHEN percent_b < 0.05::DOUBLE THEN -2 ELSE 0 END", "0"),
    "kd": ("CASE WHEN k > d_ AND j BETWEEN 20 AND 90 THEN 5 WHEN k < d_ AND j < 20 THEN -3 ELSE 0 END", "0"), "obv_trend": ("0", "CASE WHEN obv_above_ma20 THEN 4 WHEN NOT obv_above_ma20 THEN -2 ELSE 0 END"),
}


def _with(score, extra):
    return score[: -len("))::DOUBLE")] + f" + {extra}))::DOUBLE"


def _composite(extra):
    return f"(w1 * fundamental + (v2 - cut) * valuation + v3 * {_with(TECHNICAL, extra[0])} + (v4 + cut * 0.6::DOUBLE) * {_with(MOMENTUM, extra[1])} + (v5 + cut * 0.4::DOUBLE) * whale) / (w1 + (v2 - cut) + v3 + (v4 + cut * 0.6::DOUBLE) + (v5 + cut * 0.4::DOUBLE))"


@query("signal_ab", RATED + _FWD + ", " + _spreads("sp", " UNION ALL ".join(f"SELECT '{k}' AS variant, d, id, fwd, FLOOR({_composite(v)} * 1000000 + 0.5) AS v FROM rc JOIN fw USING (id, d) WHERE mode = 'balanced' AND {_ENDS}" for k, v in VARIANTS.items())) + f" SELECT variant, COUNT(x) AS days, {R4('AVG(x)')} AS mean FROM sp WHERE x IS NOT NULL GROUP BY variant")
def signal_ab(p):
    """Spread of the balanced composite with each signal switched on or off."""
    rows = rated(p, month_ends(p)).where("mode = 'balanced'")
    strong = F.coalesce(F.expr("close > ma20 AND ma5 >= ma20 AND bias >= 7 AND rsi >= 53"), F.lit(False))
    out = {}
    for name, (t, m) in R.overlays().items():
        own = {"technical": R.technical_score(extra=t), "momentum": R.momentum_score(extra=m)}
        out[name] = F.floor(R.composite_score(F.col("regime"), strong, lambda c, own=own: own.get(c, F.col(c))) * 1000000 + 0.5)
    return spreads(rows.select("d", "id", "fwd", *[v.alias(k) for k, v in out.items()]).unpivot(["d", "id", "fwd"], list(out), "variant", "v"))


@query("statement_ratios", FEATURES + f" SELECT id, known, {', '.join(f'{R4(c)} AS {c}' for c in ('net_margin', 'gross_margin', 'roe', 'asset_turnover', 'debt_to_asset', 'current_ratio', 'eps_cagr', 'ocf_to_income', 'operating_share'))}, ocf, fcf, ni FROM st")
def statement_ratios(p):
    """Every quarter's ratios, as known from their day on."""
    return statement_facts(p).select("id", "known", *[r4(F.col(c)).alias(c) for c in ("net_margin", "gross_margin", "roe", "asset_turnover", "debt_to_asset", "current_ratio", "eps_cagr", "ocf_to_income", "operating_share")], "ocf", "fcf", "ni")


@query("regime_asof", REGIME + ", e AS (SELECT id, UNNEST(GENERATE_SERIES(DATE '1995-01-31', DATE '2001-12-31', INTERVAL 1 MONTH))::DATE AS x FROM dim), m AS (SELECT id, LAST_DAY(x) AS day FROM e) SELECT m.id, m.day, COALESCE(reg.raw, 'neutral') AS regime FROM m ASOF LEFT JOIN reg ON reg.id = m.id AND m.day >= reg.d")
def regime_asof(p):
    ends = p.dim.select("id", F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("2001-12-01").cast("date"), F.expr("INTERVAL 1 MONTH"))).alias("m")).select("id", F.last_day("m").alias("day"))
    known = K.raw_regime(p.sbars).select("id", "d", "raw")
    return asof_join(ends, known, ["id"], "day", "d").select("id", "day", F.coalesce("raw", F.lit("neutral")).alias("regime"))


@query("dca_series", HELD + f""", mk AS (SELECT i, AVG(s.fwd) / 100 AS net FROM scored s JOIN cal USING (d) GROUP BY i HAVING AVG(s.fwd) IS NOT NULL), both_ AS (SELECT 'held' AS who, i, net FROM nets UNION ALL SELECT 'market', i, net FROM mk),
    e AS (SELECT *, EXP(SUM(LN(1 + net)) OVER (PARTITION BY who ORDER BY i)) AS eq FROM both_), g AS (SELECT *, COALESCE(LAG(eq) OVER (PARTITION BY who ORDER BY i), 1) AS start FROM e)
    SELECT who, i, {R4("eq * SUM(1 / start) OVER (PARTITION BY who ORDER BY i)")} AS worth FROM g""")  # fmt: skip
def dca_series(p):
    s = scored(p)
    cal = cohorts(p).select("i", "d").distinct()
    market = s.join(cal, "d").groupBy("i").agg((F.avg("fwd") / 100).alias("net")).where("net IS NOT NULL")
    of = lambda rows, who: B.contributed(rows.select("i", "net")).select(F.lit(who).alias("who"), "i", r4(F.col("worth")).alias("worth"))
    return of(nets(p), "held").unionByName(of(market, "market"))


#: The entries, with the narrower of the two buffers.
_BANDED = _ENTRY.replace("ent AS MATERIALIZED", "ent0 AS MATERIALIZED") + f""", cr AS (SELECT id, d, t, close, close / LAG(close) OVER w - 1 AS r, {_TR} AS tr FROM sbars WINDOW w AS ({P})),
    cb AS (SELECT id, t, LEAST(GREATEST(GREATEST(COALESCE({roll("STDDEV_SAMP", "r", 90, 3)}, 0) * 100, AVG(tr) OVER ({P} ROWS 13 PRECEDING) / close * 100) * 15::DOUBLE, 15), 45) AS band FROM cr),
    ent AS MATERIALIZED (SELECT e.id, t0, d0, close0, support, LEAST(buffer, band) AS buffer FROM ent0 e JOIN cb ON cb.id = e.id AND cb.t = t0)"""


@query("exit_full", _BANDED + _EXITS)
def exit_full(p):
    """Exits of an entry at every bar, by the narrower of the two buffers."""
    p = dealt(p)
    e = entries(p, T.chase_band).withColumn("buffer", F.least("buffer", "band")).drop("band")
    return B.exits(e, p.sbars).select("id", "t0", "t", "reason", r4(F.col("ret")).alias("ret"))


@query("vol_profile", """, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) AS n FROM sbars), l AS (SELECT *, MIN(close) OVER (PARTITION BY id) AS lo, MAX(close) OVER (PARTITION BY id) AS hi FROM n WHERE n <= 90),
    b AS (SELECT id, lo, hi, LEAST(29, FLOOR((close - lo) / ((hi - lo) / 30))::INT) AS bin, SUM(volume)::BIGINT AS v FROM l WHERE hi > lo GROUP BY ALL), r AS (SELECT *, COALESCE(SUM(v) OVER (PARTITION BY id ORDER BY v DESC, bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(v) OVER (PARTITION BY id) AS total, MAX(v) OVER (PARTITION BY id) AS top FROM b),
    s AS (SELECT id, ANY_VALUE(lo) AS lo, ANY_VALUE(hi) AS hi, MIN(bin) FILTER (before < total * 0.7::DOUBLE) AS a, MAX(bin) FILTER (before < total * 0.7::DOUBLE) AS z, COUNT(*) FILTER (v >= 0.25 * top) AS hvn, COUNT(*) FILTER (v <= 0.1 * top) AS lvn FROM r GROUP BY id),
    c AS (SELECT s.*, n.close, ROUND_EVEN(lo + (a + 0.5::DOUBLE) * (hi - lo) / 30, 2) AS val, ROUND_EVEN(lo + (z + 0.5::DOUBLE) * (hi - lo) / 30, 2) AS vah FROM s JOIN n ON n.id = s.id AND n.n = 1)
    SELECT id, hvn, lvn, CASE WHEN close > vah THEN 'above' WHEN close < val THEN 'below' WHEN close >= (val + vah) / 2 THEN 'upper' ELSE 'lower' END AS status FROM c""")  # fmt: skip
def vol_profile(p):
    bars = p.sbars
    by = Window.partitionBy("id")
    last = bars.withColumn("_n", F.row_number().over(by.orderBy(F.desc("d")))).where("_n <= 90").withColumns({"lo": F.min("close").over(by), "hi": F.max("close").over(by)}).where("hi > lo")
    bins = last.groupBy("id", F.least(F.lit(29), F.floor((F.col("close") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / 30)).cast("int")).alias("bin")).agg(F.sum("volume").alias("v")).withColumn("top", F.max("v").over(by))
    nodes = bins.groupBy("id").agg(F.count_if(F.expr("v >= 0.25 * top")).alias("hvn"), F.count_if(F.expr("v <= 0.1 * top")).alias("lvn"))
    now = latest_row(bars.select("id", "d", "close"), ["id"], F.desc("d"))
    c = T.volume_profile(bars).join(nodes, "id").join(now, "id")
    status = F.when(F.expr("close > vah"), "above").when(F.expr("close < val"), "below").when(F.expr("close >= (val + vah) / 2"), "upper").otherwise("lower")
    return c.select("id", "hvn", "lvn", status.alias("status"))
