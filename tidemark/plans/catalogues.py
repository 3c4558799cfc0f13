"""Catalogues of rules over point-in-time rows, overlays, attributions, pools, and the tables' policies."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import mean_of_present
from tidemark.operators import factors as X
from tidemark.operators import portfolio as B
from tidemark.operators.asof import asof_join
from tidemark.operators.windows import Series
from tidemark.sources import readers, store

from .base import R4, dealt, query, r4
from .factors import COHORT, SCORED, cohorts, scored
from .portfolios import nets
from .snapshot import FEATURES, features
from .technicals import _EW, ew_index

S = Series()

# --- filter catalogues: what each rule keeps, and how it does against the day's market ---

#: Masks over the dearest decile; unknown values pass where the rule says so.
TRAPS = {
    "baseline": "true", "earning": "ni > 0", "not_earning_by_others": "NOT (ni > 0 AND operating_share <= 0)", "core_half": "NOT (ni > 0 AND operating_share < 0.5)", "roe_positive": "roe > 0", "roe_2": "roe > 2",
    "growing": "rev_growth IS NULL OR rev_growth > 0", "not_shrinking": "rev_growth IS NULL OR rev_growth > -10", "roe_and_growth": "roe > 0 AND (rev_growth IS NULL OR rev_growth > -10)",
}
#: Rules that leave rows out; unknown values stay in.
SMART = {
    "l2": "value_pct > 90 AND NOT COALESCE(rev_growth > 0, false)", "e1_trap": "value_pct > 90 AND NOT COALESCE(rev_cagr > 0, false)", "e2_losses": "eps_pos = 0", "e3_deep": "hi < 50", "e4_falling": "hi < 60 AND NOT COALESCE(rev_cagr > 0, false)", "e5_collapse": "m6 < -30",
    "combined": "(value_pct > 90 AND NOT COALESCE(rev_growth > 0, false)) OR COALESCE(eps_pos = 0, false) OR (COALESCE(hi < 60, false) AND NOT COALESCE(rev_cagr > 0, false))",
}
ORTHO = {
    "l2": SMART["l2"], "t1_leaving": "value_pct > 90 AND big_d3 < 0", "t2_left": "big_d3 < -3", "t3_scattered": "lots_d3 > 0.15", "p1_pledged": "pledge > 80", "p2_pledged_thin": "pledge > 50 AND director < 10", "p3_pledge_trap": "value_pct > 90 AND pledge > 50",
    "combined": "(value_pct > 90 AND NOT COALESCE(rev_growth > 0, false)) OR COALESCE(value_pct > 90 AND big_d3 < 0, false) OR COALESCE(pledge > 80, false)",
}


def judged_rows(p):
    """Month-end observations with what was known of the entity, the excess return and the holders' monthly facts."""
    s = scored(p).withColumns({"value_pct": 100 - F.col("pb"), "ex": F.col("fwd") - F.avg("fwd").over(Window.partitionBy("d"))}).where("fwd IS NOT NULL").select("id", "d", "hi", "value_pct", "ex")
    known = features(p).select("id", "d", "ni", "operating_share", "roe", "rev_growth", "rev_cagr", "m6")
    rows = s.join(known, ["id", "d"])
    m = Series("id", "m")
    q = F.col("l_quantity")
    of = lambda cond: F.sum(F.when(cond, q).otherwise(0)) / F.sum("l_quantity") * 100
    held = p.table("lineitem").groupBy(F.col("l_suppkey").alias("id"), F.trunc("l_shipdate", "month").alias("m")).agg(of(q >= 40).alias("big"), F.count("*").alias("lots"), of(F.col("l_returnflag") == "R").alias("pledge"), of(F.col("l_returnflag") == "A").alias("director"))
    held = held.select("id", F.add_months("m", 1).alias("m"), "pledge", "director", (F.col("big") - m.lag("big", 3)).alias("big_d3"), (F.col("lots") / m.lag("lots", 3) - 1).alias("lots_d3"))
    quarters = p.stmt.groupBy("id", "q").agg(F.max("known_date").alias("known"), F.sum(F.when(F.col("type") == "gross", F.col("value")).otherwise(-F.col("value"))).alias("net"))
    w = Window.partitionBy("id").orderBy("q").rowsBetween(-3, 0)
    quarters = quarters.select("id", "known", F.when(F.count("*").over(w) >= 4, F.sum((F.col("net") > 0).cast("int")).over(w)).alias("eps_pos"))
    rows = asof_join(rows, quarters, ["id"], "d", "known").drop("known")
    return rows.join(held.withColumnRenamed("m", "_m"), (rows["id"] == held["id"]) & (F.trunc("d", "month") == F.col("_m")), "left").drop(held["id"])


JUDGED = FEATURES + SCORED[SCORED.index(", obs0") :] + """, hm AS (SELECT l_suppkey AS id, CAST(DATE_TRUNC('month', l_shipdate) AS DATE) AS m, COALESCE(SUM(l_quantity) FILTER (l_quantity >= 40), 0)::DOUBLE / SUM(l_quantity)::DOUBLE * 100 AS big, COUNT(*) AS lots, COALESCE(SUM(l_quantity) FILTER (l_returnflag = 'R'), 0)::DOUBLE / SUM(l_quantity)::DOUBLE * 100 AS pledge, COALESCE(SUM(l_quantity) FILTER (l_returnflag = 'A'), 0)::DOUBLE / SUM(l_quantity)::DOUBLE * 100 AS director FROM lineitem GROUP BY ALL),
    hd AS (SELECT id, CAST(m + INTERVAL 1 MONTH AS DATE) AS m, pledge, director, big - LAG(big, 3) OVER w AS big_d3, lots::DOUBLE / LAG(lots, 3) OVER w - 1 AS lots_d3 FROM hm WINDOW w AS (PARTITION BY id ORDER BY m)),
    qn AS (SELECT id, q, MAX(known_date) AS known, SUM(CASE type WHEN 'gross' THEN value ELSE -value END) AS net FROM stmt GROUP BY id, q), qe AS (SELECT id, known, CASE WHEN COUNT(*) OVER w >= 4 THEN SUM((net > 0)::INT) OVER w END AS eps_pos FROM qn WINDOW w AS (PARTITION BY id ORDER BY q ROWS 3 PRECEDING)),
    ob AS (SELECT id, d, hi, 100 - pb AS value_pct, fwd - AVG(fwd) OVER (PARTITION BY d) AS ex FROM scored), ju AS MATERIALIZED (SELECT ob.*, ni, operating_share, roe, rev_growth, rev_cagr, m6, pledge, director, big_d3, lots_d3, eps_pos FROM ob JOIN fe USING (id, d) LEFT JOIN hd ON hd.id = ob.id AND hd.m = DATE_TRUNC('month', ob.d) ASOF LEFT JOIN qe ON qe.id = ob.id AND ob.d >= qe.known WHERE ex IS NOT NULL)"""


def catalogue(name, rules, keep, pool="true"):
    sql = lambda v: f"COALESCE({v}, false)" if keep else f"NOT COALESCE({v}, false)"

    @query(name, JUDGED + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule, COUNT(*) AS n, {R4('AVG(ex)')} AS excess, {R4('AVG((ex > 0)::INT) * 100')} AS win FROM ju WHERE {pool} AND {sql(v)}" for k, v in rules.items()))
    def run(p):
        of = lambda v, x: F.when(F.expr(sql(v)), x)
        up = (F.col("ex") > 0).cast("int")
        stats = [F.struct(F.lit(k).alias("rule"), F.count(of(v, 1)).alias("n"), r4(F.avg(of(v, F.col("ex")))).alias("excess"), r4(F.avg(of(v, up)) * 100).alias("win")) for k, v in rules.items()]
        return judged_rows(p).where(pool).agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")


catalogue("trap_catalogue", TRAPS, True, "value_pct <= 10")
catalogue("smart_catalogue", SMART, False)
catalogue("ortho_catalogue", ORTHO, False)


# --- overlays: four rules of exposure over the index, decided at the month's start ---

#: Exposure below the long mean, the target volatility (percent a year), the cost of a change and the yearly rate of cash.
BEAR_EXPOSURE, VOL_TARGET, CHANGE_COST, CASH = 0.3, 15.0, 0.00285, 0.01
_RULES_SQL = {
    "binary": "CASE WHEN level >= ma200 THEN 1 ELSE 0.3::DOUBLE END", "graded": "CASE WHEN dist >= 0 THEN 1 ELSE LEAST(1, GREATEST(0, 1 + dist / 0.20::DOUBLE)) END",
    "ladder": "((level >= ma50)::INT + (level >= ma100)::INT + (level >= ma200)::INT) / 3.0::DOUBLE", "vol_target": "CASE WHEN vol60 > 0 THEN LEAST(1, GREATEST(0, 15 / vol60)) ELSE 1 END",
}


@query("overlay_rules", _EW + COHORT + f""", held AS (SELECT a.i, ANY_VALUE(a.d) AS d, 1 - COUNT(b.id)::DOUBLE / COUNT(*) AS turnover, AVG(a.fwd) / 100 AS gross FROM coh a LEFT JOIN coh b ON b.i = a.i - 1 AND b.id = a.id GROUP BY a.i HAVING AVG(a.fwd) IS NOT NULL),
    ov AS (SELECT d, level, {", ".join(f"CASE WHEN COUNT(level) OVER (ORDER BY d ROWS {k - 1} PRECEDING) = {k} THEN AVG(level) OVER (ORDER BY d ROWS {k - 1} PRECEDING) END AS ma{k}" for k in (50, 100, 200))}, CASE WHEN COUNT(ret) OVER (ORDER BY d ROWS 59 PRECEDING) = 60 THEN STDDEV_SAMP(ret) OVER (ORDER BY d ROWS 59 PRECEDING) * SQRT(252) * 100 END AS vol60 FROM idx),
    dd AS (SELECT *, level / ma200 - 1 AS dist FROM ov WHERE ma200 IS NOT NULL), e AS (SELECT i, gross - turnover * 0.00585::DOUBLE AS net, r.rule, CASE r.rule {" ".join(f"WHEN '{k}' THEN COALESCE({v}, 1)" for k, v in _RULES_SQL.items())} END AS e, dd.d IS NULL AS none FROM held LEFT JOIN dd USING (d), (VALUES ('binary'), ('graded'), ('ladder'), ('vol_target')) r(rule)),
    x AS (SELECT rule, i, CASE WHEN none THEN 1 ELSE e END AS e, net FROM e), y AS (SELECT *, e * net + (1 - e) * 0.01::DOUBLE / 12 - ABS(e - COALESCE(LAG(e) OVER (PARTITION BY rule ORDER BY i), 1)) * 0.00285::DOUBLE AS r FROM x)
    SELECT rule, i, {R4("e")} AS exposure, {R4("r", 6)} AS r FROM y""")  # fmt: skip
def overlay_rules(p):
    w = Window.orderBy("d")
    full = lambda v, k, fn: F.when(F.count(v).over(w.rowsBetween(1 - k, 0)) == k, fn(v).over(w.rowsBetween(1 - k, 0)))
    index = ew_index(p).select("d", "level", *[full("level", k, F.avg).alias(f"ma{k}") for k in (50, 100, 200)], (full("ret", 60, F.stddev_samp) * F.sqrt(F.lit(252.0)) * 100).alias("vol60"))
    index = index.where("ma200 IS NOT NULL").withColumn("dist", F.col("level") / F.col("ma200") - 1)
    one = F.lit(1.0)
    clip = lambda x: F.least(one, F.greatest(F.lit(0.0), x))
    above = lambda k: (F.col("level") >= F.col(f"ma{k}")).cast("int")
    rules = {
        "binary": F.when(F.col("level") >= F.col("ma200"), one).otherwise(BEAR_EXPOSURE), "graded": F.when(F.col("dist") >= 0, one).otherwise(clip(1 + F.col("dist") / 0.20)),
        "ladder": (above(50) + above(100) + above(200)) / 3.0, "vol_target": F.when(F.col("vol60") > 0, clip(VOL_TARGET / F.col("vol60"))).otherwise(one),
    }
    c = cohorts(p)
    days = c.groupBy("i").agg(F.first("d").alias("d"))
    rows = nets(p).join(days, "i").join(F.broadcast(index), "d", "left")
    rows = rows.select("i", "net", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, one).alias("e")) for k, v in rules.items()])).alias("x"), F.col("level").isNull().alias("none"))
    rows = rows.select("i", "net", F.col("x.rule").alias("rule"), F.when(F.col("none"), one).otherwise(F.col("x.e")).alias("e"))
    before = F.coalesce(F.lag("e").over(Window.partitionBy("rule").orderBy("i")), one)
    r = F.col("e") * F.col("net") + (1 - F.col("e")) * (CASH / 12) - F.abs(F.col("e") - before) * CHANGE_COST
    return rows.select("rule", "i", r4(F.col("e")).alias("exposure"), r4(r, 6).alias("r"))


@query("weighted_curve", COHORT + f", x AS (SELECT a.i, SUM(a.c2 * a.fwd) / SUM(a.c2) / 100 AS gross, SUM(CASE WHEN b.id IS NULL THEN a.c2 ELSE 0 END) / SUM(a.c2) AS turnover FROM coh a LEFT JOIN coh b ON b.i = a.i - 1 AND b.id = a.id WHERE a.fwd IS NOT NULL GROUP BY a.i), n AS (SELECT i, gross - turnover * 0.00585::DOUBLE AS net FROM x) SELECT i, {R4('net', 6)} AS net, {R4('EXP(SUM(LN(1 + net)) OVER (ORDER BY i))')} AS equity FROM n")
def weighted_curve(p):
    """The curve of holdings weighted by their scores."""
    kept = F.lag("i").over(Window.partitionBy("id").orderBy("i")) == F.col("i") - 1
    c = cohorts(p).withColumn("new", ~F.coalesce(kept, F.lit(False))).where("fwd IS NOT NULL")
    whole = F.sum("c2")
    n = c.groupBy("i").agg((F.sum(F.col("c2") * F.col("fwd")) / whole / 100).alias("gross"), (F.sum(F.when(F.col("new"), F.col("c2")).otherwise(0.0)) / whole).alias("turnover")).select("i", (F.col("gross") - F.col("turnover") * B.COST).alias("net"))
    return B.curve(n).select("i", r4(F.col("net"), 6).alias("net"), r4(F.col("equity")).alias("equity"))


_PARTS = ("pm", "ph", "pb", "pv")


def _mean_sql(parts):
    return f"FLOOR(({' + '.join(f'COALESCE({c}, 0)' for c in parts)}) / NULLIF({' + '.join(f'({c} IS NOT NULL)::INT' for c in parts)}, 0)::DOUBLE * 1000000 + 0.5)"


@query("factor_loo", SCORED + ", v AS (" + " UNION ALL ".join(f"SELECT '{name}' AS without, id, d, fwd, {_mean_sql([c for c in _PARTS if c != name])} AS v FROM scored WHERE fwd IS NOT NULL" for name in ("none", *_PARTS)) + f"), o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY without, d ORDER BY v, id) AS r, COUNT(*) OVER (PARTITION BY without, d) AS n FROM v WHERE v IS NOT NULL), s AS (SELECT without, d, AVG(fwd) FILTER (r > n - FLOOR(n * 0.2::DOUBLE)) - AVG(fwd) FILTER (r <= FLOOR(n * 0.2::DOUBLE)) AS x FROM o GROUP BY ALL), m AS (SELECT without, AVG(x) AS x, COUNT(x) AS days FROM s GROUP BY without) SELECT without, days, {R4('x')} AS spread, {R4('MAX(x) FILTER (without = $$none$$) OVER () - x')} AS contribution FROM m")
def factor_loo(p):
    """Spread of the composite without each factor, and what the factor adds."""
    value = lambda parts: F.floor(mean_of_present(*map(F.col, parts)) * 1000000 + 0.5)
    rows = scored(p).where("fwd IS NOT NULL").select("id", "d", "fwd", *[value([c for c in _PARTS if c != name]).alias(name) for name in ("none", *_PARTS)])
    long = rows.unpivot(["id", "d", "fwd"], ["none", *_PARTS], "without", "v")
    m = X.tail_spread(long, "v", "fwd", "without", "d").groupBy("without").agg(F.avg("spread").alias("x"), F.count("spread").alias("days"))
    whole = F.max(F.when(F.col("without") == "none", F.col("x"))).over(Window.partitionBy())
    return m.select("without", "days", r4(F.col("x")).alias("spread"), r4(whole - F.col("x")).alias("contribution"))


@query("low_corr_pool")
def low_corr_pool(p, k=8):
    """Greedy pool of the least correlated of all entities."""
    return X.low_correlation_names(dealt(p).sbars.select("id", "d", S.change("close").alias("r")), k)


@query("random_pools")
def random_pools(p, draws=20, size=45):
    """Spread of the composite's ends within seeded random pools of entities, by year."""
    ids = p.dim.select("id").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    pick = ids.withColumn("_r", F.row_number().over(Window.partitionBy("draw").orderBy(F.xxhash64(F.lit(7), "draw", "id"), "id"))).where(F.col("_r") <= size).select("draw", "id")
    rows = scored(p).where("fwd IS NOT NULL AND c2 IS NOT NULL").select("id", "d", "fwd", "c2").join(F.broadcast(pick), "id")
    s = X.tail_spread(rows, "c2", "fwd", "draw", "d")
    return s.groupBy("draw", F.year("d").alias("year")).agg(F.count("*").alias("days"), r4(F.avg("spread")).alias("spread"))


# --- users' filters, calendars, policies ---


@query("user_filter", SCORED + f" SELECT id, d, {R4('c2')} AS c2, rating FROM scored WHERE rating IN ('SUPER', 'STRONG') AND d >= DATE '1999-01-01' AND (COALESCE(pm > 85, false)::INT + COALESCE(ph > 85, false)::INT + COALESCE(pb > 85, false)::INT + COALESCE(pv > 85, false)::INT) >= 2")
def user_filter(p, ratings=("SUPER", "STRONG"), since="1999-01-01", arms=2):
    """Rows of the chosen ratings, from a day on, that so many arms confirm at least."""
    n = sum((F.coalesce(F.col(c) > 85, F.lit(False)).cast("int") for c in _PARTS), F.lit(0))
    return scored(p).where(F.col("rating").isin(*ratings) & (F.col("d") >= F.lit(since).cast("date")) & (n >= arms)).select("id", "d", r4(F.col("c2")).alias("c2"), "rating")


@query("common_calendar", "SELECT d, COUNT(DISTINCT id) AS n FROM sbars WHERE id IN (1, 2, 3) GROUP BY d HAVING COUNT(DISTINCT id) = 3")
def common_calendar(p, names=(1, 2, 3)):
    """The days that all the named series have."""
    return p.sbars.where(F.col("id").isin(*names)).groupBy("d").agg(F.countDistinct("id").alias("n")).where(F.col("n") == len(names))


@query("table_policies", ", a AS (SELECT id, d, cents FROM bars WHERE d < DATE '2000-01-01'), f AS (SELECT id, d, cents + 1 AS cents FROM bars WHERE d >= DATE '1999-12-01') SELECT 'append' AS policy, COUNT(*) AS n, SUM(cents)::BIGINT AS total FROM (SELECT * FROM a UNION ALL SELECT f.* FROM f ANTI JOIN a USING (id, d)) UNION ALL SELECT 'restate', COUNT(*), SUM(cents)::BIGINT FROM (SELECT * FROM f UNION ALL SELECT a.* FROM a ANTI JOIN f USING (id, d))")
def table_policies(p):
    """Tables that only grow keep their rows; tables that are restated take the feed's."""
    b = p.bars.select("id", "d", "cents")
    old, feed = b.where("d < DATE '2000-01-01'"), b.where("d >= DATE '1999-12-01'").withColumn("cents", F.col("cents") + 1)
    of = lambda rows, name: rows.agg(F.lit(name).alias("policy"), F.count("*").alias("n"), F.sum("cents").alias("total"))
    return of(store.upsert_first_seen(old, feed, ["id", "d"]), "append").unionByName(of(store.merge_by_priority(["id", "d"], feed, old), "restate"))


@query("late_backfill", ", g AS (SELECT id, d, volume, d - LAG(d) OVER (PARTITION BY id ORDER BY d) AS gap FROM bars), m AS (SELECT id, d, volume, CASE WHEN id % 3 = d::DATE - DATE '1995-01-01' - 3 * FLOOR((d::DATE - DATE '1995-01-01') / 3) THEN NULL ELSE volume END AS v FROM g) SELECT id, d, COALESCE(v, CASE WHEN d - LAG(CASE WHEN v IS NOT NULL THEN d END IGNORE NULLS) OVER w <= 3 THEN LAG(v IGNORE NULLS) OVER w END) AS volume, v IS NULL AS late FROM m WINDOW w AS (PARTITION BY id ORDER BY d)")
def late_backfill(p, within=3):
    """A value that isn't there yet is taken from the last day that has it, so many days back at most, and marked."""
    days = F.datediff("d", F.lit("1995-01-01").cast("date"))
    v = F.when(F.col("id") % 3 != days % 3, F.col("volume"))
    rows = p.bars.select("id", "d", v.alias("v")).withColumn("_known", F.when(F.col("v").isNotNull(), F.struct("d", "v")))
    rows = rows.withColumn("_last", F.last("_known", ignorenulls=True).over(S.w.rowsBetween(Window.unboundedPreceding, -1)))
    fill = F.when(F.datediff("d", F.col("_last.d")) <= within, F.col("_last.v"))
    return rows.select("id", "d", F.coalesce("v", fill).alias("volume"), F.col("v").isNull().alias("late"))


_ADHOC = "SELECT n_name AS nation, COUNT(*) AS suppliers, CAST(ROUND(SUM(s_acctbal) * 100) AS BIGINT) AS cents FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name"


@query("adhoc_sql", "SELECT n_name AS nation, COUNT(*) AS suppliers, CAST(ROUND(SUM(s_acctbal) * 100) AS BIGINT) AS cents FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def adhoc_sql(p, sql=_ADHOC):
    """A SQL text over the folder's tables."""
    return readers.over_tables(p.spark, p.dir, ["supplier", "nation"], sql)
