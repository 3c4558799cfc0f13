"""Factor validation, screening funnel and cohort queries over month-end observations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import folded, mean_of_present, ratio
from tidemark.functions.ranks import pct_rank, pooled_rank, quantiles
from tidemark.operators import factors as X
from tidemark.operators.asof import asof_join
from tidemark.operators.windows import Series, latest_row

from .base import R4, dealt, query, r4
from .technicals import avg_rank_sql, roll

S = Series()


def observations(p):
    """id, d, close, volume, mom, hi, bias, fwd, industry on the last trading day of each month."""
    rows = p.sbars.select(
        "id", "d", "t", "close", "volume", ((S.lag("close", 5) / F.nullif(S.lag("close", 65), F.lit(0.0)) - 1) * 100).alias("mom"),
        (F.col("close") / S.highest("close", 240, 120) * 100).alias("hi"), ((F.col("close") / S.lag("close", 20) - 1) * 100).alias("bias"),
        ((S.lead("close", 20) / F.col("close") - 1) * 100).alias("fwd"), ((S.lead("close", 5) / F.col("close") - 1) * 100).alias("fwd5"),
    )
    ends = p.sbars.groupBy(F.trunc("d", "month").alias("_m")).agg(F.max("d").alias("d")).select("d")
    return rows.join(F.broadcast(ends), "d", "left_semi").join(F.broadcast(p.dim.select("id", "industry")), "id")


OBS = f""", obs0 AS (SELECT id, d, t, close, volume, (LAG(close, 5) OVER w / NULLIF(LAG(close, 65) OVER w, 0) - 1) * 100 AS mom, close / {roll("MAX", "close", 240, 120)} * 100 AS hi,
        (close / LAG(close, 20) OVER w - 1) * 100 AS bias, (LEAD(close, 20) OVER w / close - 1) * 100 AS fwd, (LEAD(close, 5) OVER w / close - 1) * 100 AS fwd5 FROM sbars WINDOW w AS (PARTITION BY id ORDER BY d)),
    obs AS MATERIALIZED (SELECT o.*, industry FROM obs0 o JOIN dim USING (id) WHERE d IN (SELECT MAX(d) FROM sbars GROUP BY DATE_TRUNC('month', d)))"""


def avg_rank_only(v, by):
    return f"(RANK() OVER (PARTITION BY {by} ORDER BY {v}) + (COUNT(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE)"


def ic_sql(f, fwd="fwd", src="obs", by="d", least=4, name="ic"):
    return f"{name}r AS (SELECT {by}, {avg_rank_only(f, by)} AS a, {avg_rank_only(fwd, by)} AS b FROM {src} WHERE {f} IS NOT NULL AND {fwd} IS NOT NULL), {name} AS (SELECT {by}, COUNT(*) AS n, CORR(a, b) AS ic FROM {name}r GROUP BY {by} HAVING COUNT(*) >= {least})"


IC_COLS = f"COUNT(ic) AS days, {R4('AVG(ic)')} AS mean, {R4('STDDEV_SAMP(ic)')} AS sd, {R4('AVG(ic) / NULLIF(STDDEV_SAMP(ic), 0)')} AS icir, {R4('AVG(ic) / NULLIF(STDDEV_SAMP(ic), 0) * SQRT(COUNT(ic))')} AS t, {R4('AVG((ic > 1e-9)::INT)')} AS positive"


def finite(rows):
    """Days whose correlation isn't defined (no spread) are null in both engines."""
    return rows.withColumn("ic", F.nanvl("ic", F.lit(None).cast("double")))


def summary(ic, *by):
    s = X.ic_summary(finite(ic), *by)
    return s.select(*by, "days", *[r4(F.col(c)).alias(c) for c in ("mean", "sd", "icir", "t", "positive")])


@query("rank_ic", OBS + f", {ic_sql('mom')} SELECT {IC_COLS} FROM ic WHERE NOT ISNAN(ic)")
def rank_ic(p):
    return summary(X.rank_ic(observations(p), "mom", "fwd", "d"))


@query("rank_ic_daily", OBS + f", {ic_sql('hi')} SELECT d, n, {R4('ic')} AS ic FROM ic WHERE NOT ISNAN(ic)")
def rank_ic_daily(p):
    return finite(X.rank_ic(observations(p), "hi", "fwd", "d")).where("ic IS NOT NULL").select("d", "n", r4(F.col("ic")).alias("ic"))


def ordered_sql(f, by="d", where="TRUE"):
    return f"(SELECT *, ROW_NUMBER() OVER (PARTITION BY {by} ORDER BY {f}, id) AS r, COUNT(*) OVER (PARTITION BY {by}) AS n FROM obs WHERE {f} IS NOT NULL AND {where})"


def spread_sql(f, q=0.2, name="sp"):
    return f"{name} AS (SELECT d, AVG(fwd) FILTER (r > n - FLOOR(n * {q}::DOUBLE)) - AVG(fwd) FILTER (r <= FLOOR(n * {q}::DOUBLE)) AS spread FROM {ordered_sql(f, where='fwd IS NOT NULL')} GROUP BY d)"


@query("ls_spread", OBS + f", {spread_sql('mom')} SELECT COUNT(spread) AS days, {R4('AVG(spread)')} AS mean FROM sp HAVING COUNT(spread) >= 3")
def ls_spread(p):
    s = X.tail_spread(observations(p), "mom", "fwd", "d")
    return s.agg(F.count("spread").alias("days"), F.avg("spread").alias("mean")).where("days >= 3").select("days", r4(F.col("mean")).alias("mean"))


@query("quantile_ladder", OBS + f", q AS (SELECT *, ROW_NUMBER() OVER (ORDER BY hi, id, d) AS r, COUNT(*) OVER () AS n FROM obs WHERE hi IS NOT NULL AND fwd IS NOT NULL) SELECT LEAST(5, GREATEST(1, CEIL(r / n * 5)))::INT AS bucket, COUNT(*) AS n, {R4('AVG(fwd)')} AS mean, {R4('AVG((fwd > 0)::INT)')} AS win FROM q GROUP BY 1")
def quantile_ladder(p):
    known = observations(p).where("hi IS NOT NULL AND fwd IS NOT NULL")
    # pooled: month-end observations of all entities are one order, dealt to tasks by the value's range
    b = pooled_rank(known, "hi", 0.1, "id", "d").withColumn("bucket", X.bucket_share(F.col("_r"), F.col("_n"), 5))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), r4(F.avg("fwd")).alias("mean"), r4(F.avg((F.col("fwd") > 0).cast("int"))).alias("win"))


def bucket_query(kind, sql):
    def run(p):
        b = X.bucketed(observations(p).where("fwd IS NOT NULL"), "mom", 5, kind, "d")
        ex = b.withColumn("ex", F.col("fwd") - F.avg("fwd").over(Window.partitionBy("d")))
        return ex.groupBy("bucket").agg(F.count("*").alias("n"), r4(F.avg("ex")).alias("excess"))

    return run, OBS + f", q AS (SELECT *, {sql} AS bucket FROM {ordered_sql('mom', where='fwd IS NOT NULL')}), e AS (SELECT *, fwd - AVG(fwd) OVER (PARTITION BY d) AS ex FROM q) SELECT bucket, COUNT(*) AS n, {R4('AVG(ex)')} AS excess FROM e GROUP BY bucket"


for _name, _kind, _sql in (
    ("quintile_mono", "first", "CASE WHEN n > 1 THEN GREATEST(1, CEIL((r - 1) * 5 / NULLIF(n - 1, 0)))::INT ELSE 1 END"),
    ("quintile_share", "share", "LEAST(5, GREATEST(1, CEIL(r / n * 5)))::INT"),
    ("decile_excess", "slice", "((r - 1 >= FLOOR(n * 1 / 5))::INT + (r - 1 >= FLOOR(n * 2 / 5))::INT + (r - 1 >= FLOOR(n * 3 / 5))::INT + (r - 1 >= FLOOR(n * 4 / 5))::INT)"),
):
    _run, _oracle = bucket_query(_kind, _sql)
    query(_name, _oracle)(_run)


@query("top_slice", OBS + f", q AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY d ORDER BY mom DESC, id) AS k FROM obs WHERE mom IS NOT NULL AND fwd IS NOT NULL), s AS (SELECT d, AVG(fwd) FILTER (k <= 5) - AVG(fwd) FILTER (k > 5 AND k <= 10) AS x FROM q GROUP BY d) SELECT COUNT(x) AS days, {R4('AVG(x)')} AS mean FROM s")
def top_slice(p):
    k = observations(p).where("mom IS NOT NULL AND fwd IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("mom"), "id")))
    s = k.groupBy("d").agg((F.avg(F.when(F.expr("k <= 5"), F.col("fwd"))) - F.avg(F.when(F.expr("k > 5 AND k <= 10"), F.col("fwd")))).alias("x"))
    return s.agg(F.count("x").alias("days"), r4(F.avg("x")).alias("mean"))


@query(
    "ortho_ic",
    OBS + f""", rk AS (SELECT *, {avg_rank_only("hi", "d")} AS y, {avg_rank_only("mom", "d")} AS x FROM obs WHERE hi IS NOT NULL AND mom IS NOT NULL), c AS (SELECT d, REGR_SLOPE(y, x) AS s, REGR_INTERCEPT(y, x) AS i FROM rk GROUP BY d),
    z AS (SELECT rk.*, FLOOR((y - i - s * x) * 1000000 + 0.5) AS res FROM rk JOIN c USING (d)), {ic_sql("res", src="z", least=8)} SELECT {IC_COLS} FROM ic WHERE NOT ISNAN(ic)""",
)
def ortho_ic(p):
    z = X.residual_ranks(observations(p), "hi", "mom", "d").withColumn("res", F.floor(F.col("residual") * 1000000 + 0.5))
    return summary(X.rank_ic(z, "res", "fwd", "d", least=8))


@query("factor_attr", OBS + ", " + ", ".join(f"{ic_sql(f, name='i' + f)}, {spread_sql(f, name='s' + f)}" for f in ("mom", "hi", "bias")) + " " + " UNION ALL ".join(f"SELECT '{f}' AS factor, {R4(f'(SELECT AVG(ic) FROM i{f} WHERE NOT ISNAN(ic))')} AS ic, {R4(f'(SELECT AVG(spread) FROM s{f})')} AS spread" for f in ("mom", "hi", "bias")))
def factor_attr(p):
    long = observations(p).select("id", "d", "fwd", "mom", "hi", "bias").unpivot(["id", "d", "fwd"], ["mom", "hi", "bias"], "factor", "v")
    ic = finite(X.rank_ic(long, "v", "fwd", "factor", "d")).groupBy("factor").agg(r4(F.avg("ic")).alias("ic"))
    sp = X.tail_spread(long, "v", "fwd", "factor", "d").groupBy("factor").agg(r4(F.avg("spread")).alias("spread"))
    return ic.join(sp, "factor")


@query(
    "horizon_ic",
    f""", h AS (SELECT id, d, (close / LAG(close, 20) OVER w - 1) AS f, UNNEST([1, 3, 5, 10, 20]) AS h, UNNEST([LEAD(close, 1) OVER w, LEAD(close, 3) OVER w, LEAD(close, 5) OVER w, LEAD(close, 10) OVER w, LEAD(close, 20) OVER w]) / close - 1 AS fwd FROM sbars WINDOW w AS (PARTITION BY id ORDER BY d)),
    g AS (SELECT * FROM h WHERE ABS(fwd) < 0.9), {ic_sql("f", src="g", by="h, d")} SELECT h, {IC_COLS} FROM ic WHERE NOT ISNAN(ic) GROUP BY h""",
)
def horizon_ic(p):
    hs = (1, 3, 5, 10, 20)
    rows = p.sbars.select("id", "d", (F.col("close") / S.lag("close", 20) - 1).alias("f"), *[(S.lead("close", h) / F.col("close") - 1).alias(str(h)) for h in hs])
    long = rows.unpivot(["id", "d", "f"], [str(h) for h in hs], "h", "fwd").withColumn("h", F.col("h").cast("int")).where("ABS(fwd) < 0.9")
    return summary(X.rank_ic(long, "f", "fwd", "h", "d"), "h")


@query("state_tstat", OBS + f", s AS (SELECT d, CASE WHEN mom > 0 AND bias > 0 THEN 'up_up' WHEN mom > 0 AND bias < 0 THEN 'up_down' WHEN mom < 0 AND bias > 0 THEN 'down_up' WHEN mom < 0 AND bias < 0 THEN 'down_down' END AS state, fwd FROM obs), m AS (SELECT d, state, AVG(fwd) AS x FROM s WHERE state IS NOT NULL AND fwd IS NOT NULL GROUP BY ALL) SELECT state, COUNT(x) AS days, {R4('AVG(x)')} AS mean, {R4('CASE WHEN COUNT(x) >= 3 AND STDDEV_SAMP(x) > 0 THEN AVG(x) / STDDEV_SAMP(x) * SQRT(COUNT(x)) END')} AS t FROM m GROUP BY state")
def state_tstat(p):
    side = lambda c: F.when(F.col(c) > 0, "up").when(F.col(c) < 0, "down")
    s = observations(p).withColumn("state", F.concat(side("mom"), F.lit("_"), side("bias"))).where("state IS NOT NULL AND fwd IS NOT NULL")
    m = s.groupBy("d", "state").agg(F.avg("fwd").alias("x"))
    return m.groupBy("state").agg(F.count("x").alias("days"), r4(F.avg("x")).alias("mean"), r4(X.t_stat("x")).alias("t"))


@query("mom_regime_ic", OBS + f", b AS (SELECT d, AVG(mom) > 0 AS up FROM obs GROUP BY d HAVING AVG(mom) IS NOT NULL), {ic_sql('hi')} SELECT up, {IC_COLS} FROM ic JOIN b USING (d) WHERE NOT ISNAN(ic) GROUP BY up")
def mom_regime_ic(p):
    o = observations(p)
    up = o.groupBy("d").agg((F.avg("mom") > 0).alias("up")).where("up IS NOT NULL")
    return summary(X.rank_ic(o, "hi", "fwd", "d").join(up, "d"), "up")


@query("rank_agree", OBS + f", {ic_sql('mom', fwd='hi')} SELECT {IC_COLS} FROM ic WHERE NOT ISNAN(ic)")
def rank_agree(p):
    return summary(X.rank_ic(observations(p), "mom", "hi", "d"))


@query(
    "avg_pair_corr",
    f""", r AS (SELECT id, d, close / LAG(close) OVER (PARTITION BY id ORDER BY d) - 1 AS r FROM sbars), p AS (SELECT a.id AS a, b.id AS b, COUNT(*) AS n, CORR(a.r, b.r) AS c FROM r a JOIN r b ON a.d = b.d AND a.id < b.id WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 20)
    SELECT COUNT(*) AS pairs, {R4("AVG(c)")} AS mean FROM p""",
)
def avg_pair_corr(p):
    rows = dealt(p).sbars.select("id", "d", S.change("close").alias("r"))
    sums = X.correlation_sums(rows, names=p.dim.count() if hasattr(p, "dim") else None)
    # every pair stands in the sums of both its names
    return sums.agg((F.coalesce(F.sum("pairs"), F.lit(0)) / 2).cast("long").alias("pairs"), r4(F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("mean"))


@query("gap_band", f", g AS (SELECT (open / LAG(close, 2) OVER (PARTITION BY id ORDER BY d) - 1) * 100 AS g FROM sbars) SELECT {R4('QUANTILE_CONT(g, 0.1)')} AS p10, {R4('QUANTILE_CONT(g, 0.5)')} AS p50, {R4('QUANTILE_CONT(g, 0.9)')} AS p90 FROM g")
def gap_band(p):
    g = p.sbars.select(((F.col("open") / S.lag("close", 2) - 1) * 100).alias("g"))
    return quantiles(g, "g", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, 0.05).select(*[r4(F.col(c)).alias(c) for c in ("p10", "p50", "p90")])


ERAS = [("early", "1995-01-01", "1997-12-31"), ("middle", "1998-01-01", "1999-12-31"), ("late", "2000-01-01", "2001-12-31")]
_ERA_SQL = "eras(era, a, z) AS (VALUES " + ", ".join(f"('{e}', DATE '{a}', DATE '{z}')" for e, a, z in ERAS) + ")"


def eras(p):
    return F.broadcast(p.spark.createDataFrame(ERAS, "era string, a string, z string").select("era", F.col("a").cast("date").alias("a"), F.col("z").cast("date").alias("z")))


@query("era_rollup", OBS + f", {_ERA_SQL}, {ic_sql('mom')} SELECT COALESCE(era, 'all') AS era, COUNT(*) AS days, {R4('AVG(ic)')} AS mean FROM ic JOIN eras ON d BETWEEN a AND z WHERE NOT ISNAN(ic) GROUP BY ROLLUP (era)")
def era_rollup(p):
    ic = finite(X.rank_ic(observations(p), "mom", "fwd", "d")).where("ic IS NOT NULL")
    by = ic.join(eras(p), F.expr("d BETWEEN a AND z")).rollup("era").agg(F.count("*").alias("days"), r4(F.avg("ic")).alias("mean"))
    return by.withColumn("era", F.coalesce("era", F.lit("all")))


RULES = {"trend": "mom > 0", "near_high": "hi > 90", "dip": "bias < 0"}


@query("pivot_rules", OBS + ", r AS (" + " UNION ALL ".join(f"SELECT d, '{k}' AS rule, fwd FROM obs WHERE {v}" for k, v in RULES.items()) + ") SELECT d, " + ", ".join(f"{R4(f'AVG(fwd) FILTER (rule = {chr(39)}{k}{chr(39)})')} AS {k}" for k in RULES) + " FROM r GROUP BY d")
def pivot_rules(p):
    long = observations(p).select("d", "fwd", F.explode(F.array_compact(F.array(*[F.when(F.expr(v), k) for k, v in RULES.items()]))).alias("rule"))
    return long.groupBy("d").pivot("rule", list(RULES)).agg(F.avg("fwd")).select("d", *[r4(F.col(k)).alias(k) for k in RULES])


@query("era_table", OBS + f", {_ERA_SQL}, r AS (" + " UNION ALL ".join(f"SELECT d, '{k}' AS rule, fwd FROM obs WHERE {v}" for k, v in RULES.items()) + f") SELECT era, rule, COUNT(fwd) AS n, {R4('AVG(fwd)')} AS mean, COUNT(fwd) < 0.8 * COUNT(*) AS thin FROM r JOIN eras ON d BETWEEN a AND z GROUP BY ALL")
def era_table(p):
    long = observations(p).select("d", "fwd", F.explode(F.array_compact(F.array(*[F.when(F.expr(v), k) for k, v in RULES.items()]))).alias("rule"))
    return long.join(eras(p), F.expr("d BETWEEN a AND z")).groupBy("era", "rule").agg(F.count("fwd").alias("n"), r4(F.avg("fwd")).alias("mean"), (F.count("fwd") < 0.8 * F.count("*")).alias("thin"))


# --- composite, ratings ---


def scored(p):
    """observations with c2 (null-skipping mean of ranks) and a rating by its level."""
    o = observations(p)
    o = o.withColumns({"pm": pct_rank("mom", "d"), "ph": pct_rank("hi", "d"), "pb": 100 - pct_rank("bias", "d"), "pv": pct_rank("volume", "d")})
    o = o.withColumn("c2", mean_of_present(F.col("pm"), F.col("ph"), F.col("pb"), F.col("pv")))
    return o.withColumn("rating", F.when(F.col("c2") >= 70, "SUPER").when(F.col("c2") >= 55, "STRONG").when(F.col("c2") >= 35, "WATCH").otherwise("AVOID"))


_MEAN4 = "(COALESCE(pm, 0) + COALESCE(ph, 0) + COALESCE(pb, 0) + COALESCE(pv, 0)) / NULLIF((pm IS NOT NULL)::INT + (ph IS NOT NULL)::INT + (pb IS NOT NULL)::INT + (pv IS NOT NULL)::INT, 0)::DOUBLE"
SCORED = OBS + f""", ranks AS (SELECT *, {avg_rank_sql("mom", "d")} AS pm, {avg_rank_sql("hi", "d")} AS ph, 100 - {avg_rank_sql("bias", "d")} AS pb, {avg_rank_sql("volume", "d")} AS pv FROM obs),
    comp AS (SELECT *, {_MEAN4} AS c2 FROM ranks), scored AS MATERIALIZED (SELECT *, CASE WHEN c2 >= 70 THEN 'SUPER' WHEN c2 >= 55 THEN 'STRONG' WHEN c2 >= 35 THEN 'WATCH' ELSE 'AVOID' END AS rating FROM comp)"""


@query("c2_score", SCORED + f" SELECT id, d, {R4('c2')} AS c2, rating FROM scored")
def c2_score(p):
    return scored(p).select("id", "d", r4(F.col("c2")).alias("c2"), "rating")


@query("c2_slice", SCORED + f" SELECT id, d, {R4('c2')} AS c2 FROM scored WHERE d = (SELECT MAX(d) FROM scored) ORDER BY scored.c2 DESC, id LIMIT 10")
def c2_slice(p):
    s = scored(p)
    last = s.agg(F.max("d").alias("_last"))
    return s.join(F.broadcast(last), F.col("d") == F.col("_last")).orderBy(F.desc("c2"), "id").limit(10).select("id", "d", r4(F.col("c2")).alias("c2"))


@query("composites", SCORED + f" SELECT id, d, {R4('(pm + ph) / 2')} AS c1, {R4('c2')} AS c2, {R4('(ph + pb + pv) / 3')} AS c3, {R4('CASE WHEN AVG(mom) OVER (PARTITION BY d) > 0 THEN pm ELSE pb END')} AS c4 FROM scored")
def composites(p):
    up = F.avg("mom").over(Window.partitionBy("d")) > 0
    return scored(p).select("id", "d", r4((F.col("pm") + F.col("ph")) / 2).alias("c1"), r4(F.col("c2")).alias("c2"), r4((F.col("ph") + F.col("pb") + F.col("pv")) / 3).alias("c3"), r4(F.when(up, F.col("pm")).otherwise(F.col("pb"))).alias("c4"))


@query("bucket_stats", SCORED + f" SELECT rating, COUNT(fwd) AS n, {R4('AVG(fwd)')} AS mean, {R4('MEDIAN(fwd)')} AS median, {R4('AVG((fwd > 0)::INT) * 100')} AS win, {R4('STDDEV_SAMP(fwd)')} AS sd FROM scored WHERE fwd IS NOT NULL GROUP BY rating")
def bucket_stats(p):
    return scored(p).where("fwd IS NOT NULL").groupBy("rating").agg(F.count("fwd").alias("n"), r4(F.avg("fwd")).alias("mean"), r4(F.median("fwd")).alias("median"), r4(F.avg((F.col("fwd") > 0).cast("int")) * 100).alias("win"), r4(F.stddev_samp("fwd")).alias("sd"))


@query("bucket_spread", SCORED + f", m AS (SELECT rating, AVG(fwd) AS x FROM scored WHERE fwd IS NOT NULL GROUP BY rating) SELECT {R4('COALESCE(MAX(x) FILTER (rating = $$SUPER$$), MAX(x) FILTER (rating = $$STRONG$$), MAX(x) FILTER (rating = $$WATCH$$)) - MAX(x) FILTER (rating = $$AVOID$$)')} AS spread FROM m")
def bucket_spread(p):
    of = lambda r: F.avg(F.when(F.col("rating") == r, F.col("fwd")))
    return scored(p).agg(r4(F.coalesce(of("SUPER"), of("STRONG"), of("WATCH")) - of("AVOID")).alias("spread"))


@query("neutral_spread", SCORED + f", s AS (SELECT d, AVG(fwd) FILTER (rating IN ('SUPER', 'STRONG')) - AVG(fwd) FILTER (rating = 'AVOID') AS x FROM scored GROUP BY d) SELECT COUNT(x) AS days, {R4('AVG(x)')} AS mean, {R4('AVG((x > 0)::INT) * 100')} AS win FROM s WHERE x IS NOT NULL HAVING COUNT(x) >= 3")
def neutral_spread(p):
    of = lambda *r: F.avg(F.when(F.col("rating").isin(*r), F.col("fwd")))
    s = scored(p).groupBy("d").agg((of("SUPER", "STRONG") - of("AVOID")).alias("x")).where("x IS NOT NULL")
    return s.agg(F.count("x").alias("days"), r4(F.avg("x")).alias("mean"), r4(F.avg((F.col("x") > 0).cast("int")) * 100).alias("win")).where("days >= 3")


@query("rating_pivot", SCORED + f""", m AS (SELECT id, rating, COUNT(*) AS n FROM scored GROUP BY ALL), b AS (SELECT id, rating AS mode FROM m QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY n DESC, rating) = 1)
    SELECT s.id, COUNT(*) FILTER (rating = 'SUPER') AS SUPER, COUNT(*) FILTER (rating = 'STRONG') AS STRONG, COUNT(*) FILTER (rating = 'WATCH') AS WATCH, COUNT(*) FILTER (rating = 'AVOID') AS AVOID, {R4("AVG(fwd)")} AS mean, ANY_VALUE(mode) AS mode FROM scored s JOIN b ON b.id = s.id GROUP BY s.id""")  # fmt: skip
def rating_pivot(p):
    s = scored(p)
    mode = latest_row(s.groupBy("id", "rating").agg(F.count("*").alias("n")), ["id"], F.desc("n"), F.col("rating")).select("id", F.col("rating").alias("mode"))
    counts = s.groupBy("id").agg(*[F.count_if(F.col("rating") == r).alias(r) for r in ("SUPER", "STRONG", "WATCH", "AVOID")], r4(F.avg("fwd")).alias("mean"))
    return counts.join(mode, "id")


GATES = {"g_mom": "mom > 0", "g_hi": "hi > 85", "g_bias": "bias BETWEEN -5 AND 15", "g_vol": "pv >= 30", "g_c2": "c2 >= 50"}


@query("gate_flags", SCORED + " SELECT id, d, " + ", ".join(f"COALESCE({v}, false) AS {k}" for k, v in GATES.items()) + " FROM scored")
def gate_flags(p):
    return scored(p).select("id", "d", *[F.coalesce(F.expr(v), F.lit(False)).alias(k) for k, v in GATES.items()])


@query("gate_diagnose", SCORED + ", f AS (SELECT " + ", ".join(f"COALESCE({v}, false)::INT AS {k}" for k, v in GATES.items()) + f" FROM scored), g AS (SELECT *, {' + '.join(GATES)} AS n FROM f) " + " UNION ALL ".join(f"SELECT '{k}' AS gate, {R4(f'AVG(1 - {k}) * 100')} AS failed, (COUNT(*) FILTER (n = {len(GATES) - 1} AND {k} = 0)) AS alone, (COUNT(*) FILTER (n = {len(GATES)})) AS passed FROM g" for k in GATES))
def gate_diagnose(p):
    f = scored(p).select("id", "d", *[F.coalesce(F.expr(v), F.lit(False)).cast("int").alias(k) for k, v in GATES.items()])
    f = f.withColumn("n", sum((F.col(k) for k in list(GATES)[1:]), F.col(list(GATES)[0])))
    long = f.unpivot(["id", "d", "n"], list(GATES), "gate", "ok")
    return long.groupBy("gate").agg(r4(F.avg(1 - F.col("ok")) * 100).alias("failed"), F.count_if((F.col("n") == len(GATES) - 1) & (F.col("ok") == 0)).alias("alone"), F.count_if(F.col("n") == len(GATES)).alias("passed"))


@query("rating_changes", SCORED + ", l AS (SELECT id, d, rating, LAG(rating) OVER (PARTITION BY id ORDER BY d) AS before FROM scored) SELECT id, d, before, rating, CASE WHEN LIST_POSITION(['AVOID', 'WATCH', 'STRONG', 'SUPER'], rating) > LIST_POSITION(['AVOID', 'WATCH', 'STRONG', 'SUPER'], before) THEN 'up' ELSE 'down' END AS move FROM l WHERE before <> rating")
def rating_changes(p):
    order = F.array(*map(F.lit, ("AVOID", "WATCH", "STRONG", "SUPER")))
    l = scored(p).select("id", "d", "rating", S.lag("rating").alias("before")).where("before <> rating")
    return l.select("id", "d", "before", "rating", F.when(F.array_position(order, F.col("rating")) > F.array_position(order, F.col("before")), "up").otherwise("down").alias("move"))


@query("review_stats", SCORED + f", last AS (SELECT id, ARG_MAX(close, d) AS now FROM sbars GROUP BY id) SELECT rating, COUNT(*) AS n, {R4('AVG((now / close - 1) * 100)')} AS mean, {R4('AVG((now > close)::INT) * 100')} AS win FROM scored JOIN last USING (id) GROUP BY rating")
def review_stats(p):
    last = p.sbars.groupBy("id").agg(F.max_by("close", "d").alias("now"))
    return scored(p).join(last, "id").groupBy("rating").agg(F.count("*").alias("n"), r4(F.avg((F.col("now") / F.col("close") - 1) * 100)).alias("mean"), r4(F.avg((F.col("now") > F.col("close")).cast("int")) * 100).alias("win"))


@query("screen_latest", SCORED + f", l AS (SELECT * FROM scored QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) = 1) SELECT id, d, {R4('c2')} AS c2, rating, FLOOR(PERCENT_RANK() OVER (ORDER BY c2) * 1000::DOUBLE + 0.5::DOUBLE)::BIGINT::DOUBLE / 10::DOUBLE AS pr FROM l WHERE c2 >= 40 AND rating IN ('SUPER', 'STRONG', 'WATCH') ORDER BY l.c2 DESC, id LIMIT 20")
def screen_latest(p):
    rows = latest_row(scored(p), ["id"], F.desc("d")).where("c2 >= 40 AND rating IN ('SUPER', 'STRONG', 'WATCH')")
    ranked = rows.withColumn("pr", r4(F.percent_rank().over(Window.orderBy("c2")) * 100, 1))
    return ranked.orderBy(F.desc("c2"), "id").limit(20).select("id", "d", r4(F.col("c2")).alias("c2"), "rating", "pr")


@query("watch_sort", SCORED + " SELECT id, ROW_NUMBER() OVER (ORDER BY (bias <= 0) IS NOT TRUE, COALESCE(ABS(bias), 9999), id) AS place FROM scored WHERE d = (SELECT MAX(d) FROM scored)")
def watch_sort(p):
    s = scored(p)
    s = s.join(F.broadcast(s.agg(F.max("d").alias("_last"))), F.col("d") == F.col("_last"))
    out_of_zone = ~F.coalesce(F.col("bias") <= 0, F.lit(False))
    return s.select("id", F.row_number().over(Window.orderBy(out_of_zone, F.coalesce(F.abs("bias"), F.lit(9999.0)), "id")).alias("place"))


# --- funnel ---

_YOY = ", y AS (SELECT a.id, a.known_date, a.revenue::DOUBLE / NULLIF(b.revenue, 0)::DOUBLE - 1::DOUBLE AS yoy FROM revm a LEFT JOIN revm b ON a.id = b.id AND b.m = a.m - INTERVAL 1 YEAR)"
FUNNEL = SCORED + _YOY + f""", adv AS (SELECT id, d, (SUM(volume) OVER (PARTITION BY id ORDER BY d ROWS 19 PRECEDING))::DOUBLE / COUNT(*) OVER (PARTITION BY id ORDER BY d ROWS 19 PRECEDING) AS adv20, MIN(d) OVER (PARTITION BY id) AS first FROM bars),
    fun AS MATERIALIZED (SELECT s.*, adv20, first, y.yoy, 100 - s.pb AS value_pct FROM scored s JOIN adv USING (id, d) ASOF LEFT JOIN y ON y.id = s.id AND s.d >= y.known_date)"""


def funnel(p):
    last = S.last(20)
    adv = p.bars.select("id", "d", (F.sum("volume").over(last).cast("double") / F.count("*").over(last)).alias("adv20"), F.min("d").over(Window.partitionBy("id")).alias("first"))
    r = p.revm
    y = r.join(r.select("id", F.add_months("m", 12).alias("m"), F.col("revenue").alias("before")), ["id", "m"], "left").select("id", "known_date", (ratio("revenue", "before") - 1).alias("yoy"))
    return asof_join(scored(p).join(adv, ["id", "d"]), y, ["id"], "d", "known_date").withColumn("value_pct", 100 - F.col("pb"))


L0, L1 = "value_pct IS NOT NULL", "adv20 >= 28 AND DATEDIFF(d, first) >= 365"
L1_SQL = "adv20 >= 28 AND d - first >= 365"
TRAP = "COALESCE(value_pct > 60, false) AND NOT COALESCE(yoy > 0, false)"
ARMS = {"value": "pb > 85", "revenue": "yoy > 0.3", "momentum": "pm > 85", "high": "ph > 85", "volume": "pv > 85"}


def simple(name, sql_where, where=None):
    @query(name, FUNNEL + f" SELECT id, d FROM fun WHERE {sql_where}")
    def run(p):
        return funnel(p).where(where or sql_where).select("id", "d")


simple("funnel_l0", L0)
simple("funnel_l1", L1_SQL, L1)
simple("funnel_l2", f"NOT ({TRAP})")
simple("quality_filter", "COALESCE(yoy > 0, false) AND COALESCE(c2 >= 50, true)")
simple("trap_filters", "COALESCE(yoy > -0.1, true) AND COALESCE(hi > 70, false) AND NOT COALESCE(mom < -20, false)")
simple("smart_excl", "NOT (COALESCE(mom < -15, false) OR COALESCE(hi < 65, false) OR COALESCE(adv20 < 20, true))")
simple("ortho_excl", "COALESCE(bias > -10, true) AND COALESCE(bias < 20, true) AND COALESCE(yoy > -0.5, true)")
simple("shortlist_union", " OR ".join(f"COALESCE({v}, false)" for v in ARMS.values()))
simple("inst_gate", "volume IS NULL OR (pv >= 30 AND (COALESCE(mom > 3, false) OR COALESCE(bias > 3, false) OR pv >= 50))")


@query("union_recipes", FUNNEL + " SELECT id, d, COALESCE(pb > 85 OR pm > 85 OR ph > 85, false) AS r3, COALESCE(pb > 85 OR pm > 85 OR ph > 85 OR yoy > 0.3, false) AS r3p1, COALESCE(pb > 85 OR ph > 85 OR pv > 85 OR yoy > 0.3, false) AS r4 FROM fun")
def union_recipes(p):
    of = lambda x: F.coalesce(F.expr(x), F.lit(False))
    return funnel(p).select("id", "d", of("pb > 85 OR pm > 85 OR ph > 85").alias("r3"), of("pb > 85 OR pm > 85 OR ph > 85 OR yoy > 0.3").alias("r3p1"), of("pb > 85 OR ph > 85 OR pv > 85 OR yoy > 0.3").alias("r4"))


@query("value_fold", FUNNEL + f" SELECT id, d, {R4('CASE WHEN value_pct <= 90 THEN value_pct ELSE 180 - value_pct END')} AS folded FROM fun")
def value_fold(p):
    return funnel(p).select("id", "d", r4(folded(F.col("value_pct"), 90.0)).alias("folded"))


_ARMS_SQL = "list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, v in ARMS.items()) + "], lambda x: x IS NOT NULL)"


@query("arm_gate", FUNNEL + f", a AS (SELECT id, d, yoy, {_ARMS_SQL} AS arms FROM fun) SELECT id, d, array_to_string(arms, '+') AS arms FROM a WHERE len(arms) > 0 AND NOT (len(arms) = 1 AND arms[1] = 'value') AND (COALESCE(yoy > 0, false) OR len(arms) >= 2)")
def arm_gate(p):
    arms = F.array_compact(F.array(*[F.when(F.expr(v), k) for k, v in ARMS.items()]))
    a = funnel(p).select("id", "d", "yoy", arms.alias("arms")).where("size(arms) > 0 AND NOT (size(arms) = 1 AND arms[0] = 'value') AND (COALESCE(yoy > 0, false) OR size(arms) >= 2)")
    return a.select("id", "d", F.concat_ws("+", "arms").alias("arms"))


@query("fill_sanity", ", f AS (SELECT id, d, close * (1 + ((id * 7 + t) % 60 - 30) / 100.0::DOUBLE) AS price, LEAST(open, close) * 0.85::DOUBLE AS lo, GREATEST(open, close) * 1.15::DOUBLE AS hi FROM sbars) SELECT id, d, price BETWEEN lo AND hi AS ok FROM f")
def fill_sanity(p):
    f = p.sbars.select("id", "d", (F.col("close") * (1 + ((F.col("id") * 7 + F.col("t")) % 60 - 30) / 100.0)).alias("price"), (F.least("open", "close") * 0.85).alias("lo"), (F.greatest("open", "close") * 1.15).alias("hi"))
    return f.select("id", "d", F.col("price").between(F.col("lo"), F.col("hi")).alias("ok"))


@query("funnel_lab", FUNNEL + f", l AS (SELECT *, ({L1_SQL}) AS l1, NOT ({TRAP}) AS l2, c2 >= 40 AS l3 FROM fun WHERE fwd IS NOT NULL) SELECT 'L0' AS level, COUNT(*) AS n, {R4('AVG(fwd)')} AS mean FROM l UNION ALL SELECT 'L1', COUNT(*), {R4('AVG(fwd)')} FROM l WHERE l1 UNION ALL SELECT 'L2', COUNT(*), {R4('AVG(fwd)')} FROM l WHERE l1 AND l2 UNION ALL SELECT 'L3', COUNT(*), {R4('AVG(fwd)')} FROM l WHERE l1 AND l2 AND l3")
def funnel_lab(p):
    l = funnel(p).where("fwd IS NOT NULL").select("fwd", F.coalesce(F.expr(L1), F.lit(False)).alias("l1"), (~F.expr(TRAP)).alias("l2"), F.coalesce(F.expr("c2 >= 40"), F.lit(False)).alias("l3"))
    depth = F.when(~F.col("l1"), 0).when(~F.col("l2"), 1).when(~F.col("l3"), 2).otherwise(3)
    levels = l.select("fwd", F.explode(F.sequence(F.lit(0), depth)).alias("k"))
    return levels.groupBy("k").agg(F.count("*").alias("n"), r4(F.avg("fwd")).alias("mean")).select(F.concat(F.lit("L"), F.col("k")).alias("level"), "n", "mean")


# --- cohorts ---

COHORT = SCORED + ", cal AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM scored)), coh AS MATERIALIZED (SELECT i, d, id, c2, fwd FROM scored JOIN cal USING (d) QUALIFY ROW_NUMBER() OVER (PARTITION BY d ORDER BY c2 DESC, id) <= 8)"


def cohorts(p, k=8):
    """i (number of the date), d, id, c2, fwd of each date's top k."""
    top = scored(p).withColumn("_n", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("c2"), "id"))).where(F.col("_n") <= k)
    # every date has a top: the k rows of each date are numbered, in one task of a size that the calendar bounds
    return top.select(F.dense_rank().over(Window.orderBy("d")).alias("i"), "d", "id", "c2", "fwd")


@query("digest_diff", COHORT + ", l AS (SELECT MAX(i) AS l FROM coh) SELECT 'new' AS side, id FROM coh, l WHERE i = l AND id NOT IN (SELECT id FROM coh, l WHERE i = l - 1) UNION ALL SELECT 'dropped', id FROM coh, l WHERE i = l - 1 AND id NOT IN (SELECT id FROM coh, l WHERE i = l)")
def digest_diff(p):
    c = cohorts(p)
    last = F.broadcast(c.agg(F.max("i").alias("l")))
    both = c.join(last, F.expr("i >= l - 1")).select("id", (F.col("i") == F.col("l")).alias("now"))
    sides = both.groupBy("id").agg(F.bool_or("now").alias("now"), F.bool_or(~F.col("now")).alias("before")).where("now <> before")
    return sides.select(F.when(F.col("now"), "new").otherwise("dropped").alias("side"), "id")


@query("jaccard", SCORED + f", r AS (SELECT d, pm >= 80 AS a, ph >= 80 AS b FROM scored WHERE pm IS NOT NULL AND ph IS NOT NULL) SELECT d, COUNT(*) FILTER (a AND b) AS both_, {R4('(COUNT(*) FILTER (a AND b))::DOUBLE / NULLIF(COUNT(*) FILTER (a OR b), 0)::DOUBLE')} AS jaccard FROM r GROUP BY d")
def jaccard(p):
    r = scored(p).where("pm IS NOT NULL AND ph IS NOT NULL").groupBy("d").agg(F.count_if(F.expr("pm >= 80 AND ph >= 80")).alias("both_"), F.count_if(F.expr("pm >= 80 OR ph >= 80")).alias("any_"))
    return r.select("d", "both_", r4(ratio("both_", "any_")).alias("jaccard"))


@query("turnover", COHORT + f" SELECT a.i, a.d, {R4('1 - COUNT(b.id)::DOUBLE / COUNT(*)')} AS turnover FROM coh a LEFT JOIN coh b ON b.i = a.i - 1 AND b.id = a.id GROUP BY a.i, a.d")
def turnover(p):
    c = cohorts(p)
    prev = c.select((F.col("i") + 1).alias("i"), "id", F.lit(1).alias("kept"))
    return c.join(prev, ["i", "id"], "left").groupBy("i", "d").agg(r4(1 - F.count("kept").cast("double") / F.count("*")).alias("turnover"))


@query("list_streak", COHORT + ", g AS (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY id ORDER BY i) AS g FROM coh) SELECT id, d, ROW_NUMBER() OVER (PARTITION BY id, g ORDER BY i) AS streak FROM g")
def list_streak(p):
    g = cohorts(p).withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("id").orderBy("i")))
    return g.select("id", "d", F.row_number().over(Window.partitionBy("id", "g").orderBy("i")).alias("streak"))


@query("streak_buckets", COHORT + f", g AS (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY id ORDER BY i) AS g FROM coh), s AS (SELECT d, fwd, ROW_NUMBER() OVER (PARTITION BY id, g ORDER BY i) AS k FROM g), b AS (SELECT d, CASE WHEN k = 1 THEN 'new' WHEN k <= 3 THEN 'short' ELSE 'long' END AS bucket, AVG(fwd) AS x FROM s WHERE fwd IS NOT NULL GROUP BY ALL) SELECT bucket, COUNT(*) AS days, {R4('AVG(x)')} AS mean FROM b GROUP BY bucket")
def streak_buckets(p):
    g = cohorts(p).withColumn("g", F.col("i") - F.row_number().over(Window.partitionBy("id").orderBy("i")))
    k = F.row_number().over(Window.partitionBy("id", "g").orderBy("i"))
    s = g.withColumn("bucket", F.when(k == 1, "new").when(k <= 3, "short").otherwise("long")).where("fwd IS NOT NULL")
    return s.groupBy("bucket", "d").agg(F.avg("fwd").alias("x")).groupBy("bucket").agg(F.count("*").alias("days"), r4(F.avg("x")).alias("mean"))


@query("funnel_stats", COHORT + f""", w AS (SELECT id, d, {avg_rank_sql("fwd", "d")} > 80 AS win FROM scored WHERE fwd IS NOT NULL), e AS (SELECT id, d, fwd - AVG(fwd) OVER (PARTITION BY d) AS ex FROM scored WHERE fwd IS NOT NULL)
    SELECT {R4("(COUNT(*) FILTER (win AND c.id IS NOT NULL))::DOUBLE / NULLIF(COUNT(*) FILTER (win), 0)::DOUBLE")} AS recall, {R4("AVG(ex) FILTER (c.id IS NOT NULL)")} AS excess FROM w JOIN e USING (id, d) LEFT JOIN coh c ON c.id = w.id AND c.d = w.d""")  # fmt: skip
def funnel_stats(p):
    w = scored(p).where("fwd IS NOT NULL").select("id", "d", (pct_rank("fwd", "d") > 80).alias("win"), (F.col("fwd") - F.avg("fwd").over(Window.partitionBy("d"))).alias("ex"))
    j = w.join(cohorts(p).select("id", "d", F.lit(1).alias("in_")), ["id", "d"], "left")
    return j.agg(r4(ratio(F.count_if(F.expr("win AND in_ = 1")), F.count_if("win"))).alias("recall"), r4(F.avg(F.when(F.col("in_") == 1, F.col("ex")))).alias("excess"))


@query("ledger", COHORT + f", {ic_sql('c2', src='scored')}, {ic_sql('c2', src='coh', name='ics')}, e AS (SELECT c.d, AVG(c.fwd) - ANY_VALUE(m.f) AS ex FROM coh c JOIN (SELECT d, AVG(fwd) AS f FROM scored GROUP BY d) m ON m.d = c.d GROUP BY c.d) SELECT ic.d, {R4('ic.ic')} AS pool_ic, {R4('CASE WHEN NOT ISNAN(ics.ic) THEN ics.ic END')} AS list_ic, {R4('ex')} AS excess FROM ic LEFT JOIN ics USING (d) LEFT JOIN e USING (d) WHERE NOT ISNAN(ic.ic)")
def ledger(p):
    s, c = scored(p), cohorts(p)
    pool = finite(X.rank_ic(s, "c2", "fwd", "d")).where("ic IS NOT NULL").select("d", r4(F.col("ic")).alias("pool_ic"))
    own = finite(X.rank_ic(c, "c2", "fwd", "d")).select("d", r4(F.col("ic")).alias("list_ic"))
    ex = c.groupBy("d").agg(F.avg("fwd").alias("a")).join(s.groupBy("d").agg(F.avg("fwd").alias("b")), "d").select("d", r4(F.col("a") - F.col("b")).alias("excess"))
    return pool.join(own, "d", "left").join(ex, "d", "left")


@query("decile_profile", SCORED + f", q AS (SELECT *, LEAST(5, GREATEST(1, CEIL(ROW_NUMBER() OVER (PARTITION BY d ORDER BY c2, id) / COUNT(*) OVER (PARTITION BY d) * 5)))::INT AS bucket FROM scored WHERE c2 IS NOT NULL) SELECT bucket, {R4('MEDIAN(mom)')} AS mom, {R4('MEDIAN(hi)')} AS hi, {R4('MEDIAN(bias)')} AS bias FROM q GROUP BY bucket")
def decile_profile(p):
    return X.bucketed(scored(p), "c2", 5, "share", "d").groupBy("bucket").agg(*[r4(F.median(c)).alias(c) for c in ("mom", "hi", "bias")])


@query("recipe_sweep", SCORED + f", m AS (SELECT recipe, k, d, AVG(fwd) AS x FROM (SELECT d, fwd, UNNEST(['pm', 'ph', 'c2']) AS recipe, UNNEST([ROW_NUMBER() OVER (PARTITION BY d ORDER BY pm DESC NULLS LAST, id), ROW_NUMBER() OVER (PARTITION BY d ORDER BY ph DESC NULLS LAST, id), ROW_NUMBER() OVER (PARTITION BY d ORDER BY c2 DESC NULLS LAST, id)]) AS r FROM scored) CROSS JOIN (VALUES (5), (10)) s(k) WHERE r <= k GROUP BY ALL) SELECT recipe, k, {R4('AVG(x)')} AS mean, {R4('MIN(x)')} AS worst FROM m WHERE x IS NOT NULL GROUP BY ALL")
def recipe_sweep(p):
    rank = lambda c: F.row_number().over(Window.partitionBy("d").orderBy(F.col(c).desc_nulls_last(), "id"))
    long = scored(p).select("d", "id", "fwd", *[rank(c).alias(c + "_r") for c in ("pm", "ph", "c2")]).unpivot(["d", "id", "fwd"], ["pm_r", "ph_r", "c2_r"], "recipe", "r")
    sizes = long.withColumn("k", F.explode(F.array(F.lit(5), F.lit(10)))).where("r <= k")
    m = sizes.groupBy("recipe", "k", "d").agg(F.avg("fwd").alias("x")).where("x IS NOT NULL")
    return m.groupBy("recipe", "k").agg(r4(F.avg("x")).alias("mean"), r4(F.min("x")).alias("worst")).withColumn("recipe", F.substring("recipe", 1, 2))


@query("decile_industry", SCORED + f", g AS (SELECT d, industry, COUNT(*) AS n, COUNT(*) FILTER (c2 >= 60) AS top FROM scored GROUP BY ALL) SELECT industry, SUM(n)::BIGINT AS n, {R4('SUM(top)::DOUBLE / SUM(SUM(top)) OVER ()::DOUBLE')} AS share_top, {R4('SUM(n)::DOUBLE / SUM(SUM(n)) OVER ()::DOUBLE')} AS share_all FROM g GROUP BY industry")
def decile_industry(p):
    g = scored(p).groupBy("industry").agg(F.count("*").alias("n"), F.count_if(F.expr("c2 >= 60")).alias("top"))
    all_ = Window.partitionBy()
    return g.select("industry", "n", r4(ratio("top", F.sum("top").over(all_))).alias("share_top"), r4(ratio("n", F.sum("n").over(all_))).alias("share_all"))
