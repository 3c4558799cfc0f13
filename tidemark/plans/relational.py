"""Scans, upserts, set operations, point-in-time joins and plain aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import pct_rank
from tidemark.operators.asof import asof_join, nearest_join, shifted_join
from tidemark.operators.windows import Series, latest_row
from tidemark.sources import store

from .base import R4, query, r4

S = Series()


@query("bars_build", "SELECT id, d, cents, volume, n, " + R4("low") + " AS low, " + R4("high") + " AS high FROM bars")
def bars_build(p):
    return p.bars.select("id", "d", "cents", "volume", "n", r4(F.col("low")).alias("low"), r4(F.col("high")).alias("high"))


@query("scan_entity", "SELECT id, d, cents, volume FROM bars WHERE id = 7")
def scan_entity(p):
    return store.scan_entity(p.bars.select("id", "d", "cents", "volume"), "id", 7)


@query("scan_union_by_name", "SELECT id, d, cents, volume, NULL::BIGINT AS net FROM bars WHERE d < DATE '1996-01-01' UNION ALL BY NAME SELECT id, d, net FROM ubars")
def scan_union_by_name(p):
    old = p.bars.where("d < DATE '1996-01-01'").select("id", "d", "cents", "volume")
    return old.unionByName(p.ubars.select("id", "d", "net"), allowMissingColumns=True)


@query("pit_slice", "SELECT id, COUNT(*) AS n, MAX(d) AS last FROM bars WHERE d <= DATE '1998-06-30' GROUP BY id")
def pit_slice(p):
    return p.bars.where(F.col("d") <= F.lit("1998-06-30").cast("date")).groupBy("id").agg(F.count("*").alias("n"), F.max("d").alias("last"))


@query(
    "upsert_first_seen",
    """, old AS (SELECT id, d, cents FROM bars WHERE d <= DATE '1998-01-01'), new AS (SELECT id, d, cents + 1 AS cents FROM bars WHERE d >= DATE '1997-06-01')
    SELECT * FROM old UNION ALL SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = new.id AND old.d = new.d)""",
)
def upsert_first_seen(p):
    b = p.bars.select("id", "d", "cents")
    return store.upsert_first_seen(b.where("d <= DATE '1998-01-01'"), b.where("d >= DATE '1997-06-01'").withColumn("cents", F.col("cents") + 1), ["id", "d"])


@query(
    "upsert_keep_last",
    """, both_ AS (SELECT id, DATE_TRUNC('month', d)::DATE AS m, cents, d AS built, 0 AS src FROM bars WHERE d < DATE '1998-01-01' UNION ALL SELECT id, DATE_TRUNC('month', d)::DATE, cents, d, 1 FROM bars WHERE d >= DATE '1997-01-01')
    SELECT id, m, cents, built FROM both_ QUALIFY ROW_NUMBER() OVER (PARTITION BY id, m ORDER BY built DESC, src DESC) = 1""",
)
def upsert_keep_last(p):
    b = p.bars.select("id", F.trunc("d", "month").alias("m"), "cents", F.col("d").alias("built"))
    return store.upsert_keep_last(b.where("built < DATE '1998-01-01'"), b.where("built >= DATE '1997-01-01'"), ["id", "m"], "built")


@query(
    "seed_priority_merge",
    """, a AS (SELECT id, q, type, value FROM stmt WHERE q <= DATE '1998-01-01'), b AS (SELECT id, q, type, value + 5 AS value FROM stmt WHERE q >= DATE '1997-01-01')
    SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.id = b.id AND a.q = b.q AND a.type = b.type)""",
)
def seed_priority_merge(p):
    s = p.stmt.select("id", "q", "type", "value")
    return store.merge_by_priority(["id", "q", "type"], s.where("q <= DATE '1998-01-01'"), s.where("q >= DATE '1997-01-01'").withColumn("value", F.col("value") + 5))


@query(
    "seed_delta_union",
    """, seed AS (SELECT id, d, cents FROM bars WHERE d <= DATE '1999-03-01')
    SELECT id, d, cents, NULL::BIGINT AS volume FROM seed UNION ALL SELECT id, d, cents, volume FROM bars WHERE d > (SELECT MAX(d) FROM seed)""",
)
def seed_delta_union(p):
    seed = p.bars.select("id", "d", "cents").where("d <= DATE '1999-03-01'")
    return store.seed_and_delta(seed, p.bars.select("id", "d", "cents", "volume"), "d")


@query(
    "incr_watermark",
    """, old AS (SELECT id, d, cents FROM bars WHERE d <= DATE '1999-03-01'), feed AS (SELECT id, d, cents * 2 AS cents FROM bars)
    SELECT id, d, cents FROM old WHERE d < (SELECT MAX(d) FROM old) UNION ALL SELECT id, d, cents FROM feed WHERE d >= (SELECT MAX(d) FROM old)""",
)
def incr_watermark(p):
    b = p.bars.select("id", "d", "cents")
    return store.since_watermark(b.where("d <= DATE '1999-03-01'"), b.withColumn("cents", F.col("cents") * 2), ["id", "d"], "d")


@query(
    "dedup_keep",
    """, both_ AS (SELECT id, m, revenue, 0 AS src FROM revm WHERE m < DATE '1998-01-01' UNION ALL SELECT id, m, revenue + 1, 1 FROM revm)
    SELECT id, m, revenue FROM both_ QUALIFY ROW_NUMBER() OVER (PARTITION BY id, m ORDER BY src) = 1""",
)
def dedup_keep(p):
    r = p.revm.select("id", "m", "revenue")
    return store.merge_by_priority(["id", "m"], r.where("m < DATE '1998-01-01'"), r.withColumn("revenue", F.col("revenue") + 1))


@query("import_normalise", "SELECT s_suppkey::VARCHAR AS id, REPLACE(s_name, '#', ' ') AS id_name, DATE '1998-03-01' AS d, FLOOR(s_acctbal)::DOUBLE * 1000 AS balance, NULL::DOUBLE AS bad FROM supplier")
def import_normalise(p):
    sheet = p.table("supplier").select(
        F.concat_ws("  ", F.col("s_suppkey").cast("string"), F.regexp_replace("s_name", "#", " ")).alias("_c0"), F.lit("19980301").alias("_c1"),
        F.format_number(F.floor("s_acctbal"), 0).alias("_c2"), F.lit("--").alias("_c3"),
    )
    return store.positional(sheet, {0: "id", 1: "d", 2: "balance", 3: "bad"}, {"balance", "bad"}, {"balance"}, "id", "d", 4)


@query("snapshot_normalise", "SELECT event_id, user_id, CAST(ts AS DATE) AS d, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def snapshot_normalise(p):
    rows = p.table("events").select("event_id", "user_id", F.to_date("ts").alias("d"), F.from_json("props", "k bigint")["k"].alias("k"))
    return store.checked(rows, 10, "events")


@query("melt_statements", "SELECT s_suppkey AS id, 'balance' AS type, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier")
def melt_statements(p):
    wide = p.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").cast("double").alias("nation"))
    return store.melted(wide, ["id"], ["balance", "nation"])


@query("asof_join", "SELECT b.id, b.d, f.m, f.revenue FROM bars b ASOF LEFT JOIN revm f ON b.id = f.id AND b.d >= f.known_date")
def asof_revenue(p):
    return asof_join(p.bars.select("id", "d"), p.revm, ["id"], "d", "known_date").select("id", "d", "m", "revenue")


@query("asof_join_tol", "SELECT b.id, b.d, CASE WHEN b.d - f.known_date <= 20 THEN f.revenue END AS revenue FROM bars b ASOF LEFT JOIN revm f ON b.id = f.id AND b.d >= f.known_date")
def asof_revenue_tol(p):
    return asof_join(p.bars.select("id", "d"), p.revm, ["id"], "d", "known_date", 20).select("id", "d", "revenue")


@query(
    "asof_fundamentals",
    """, g AS (SELECT id, q, known_date, value, SUM(value) OVER (PARTITION BY id ORDER BY q ROWS 3 PRECEDING)::BIGINT AS ttm FROM stmt WHERE type = 'gross')
    SELECT b.id, b.d, g.q, g.value, g.ttm FROM sbars b ASOF LEFT JOIN g ON b.id = g.id AND b.d >= g.known_date""",
)
def asof_fundamentals(p):
    g = p.stmt.where("type = 'gross'").withColumn("ttm", F.sum("value").over(Window.partitionBy("id").orderBy("q").rowsBetween(-3, 0)))
    return asof_join(p.sbars.select("id", "d"), g.drop("type"), ["id"], "d", "known_date").select("id", "d", "q", "value", "ttm")


@query(
    "asof_yield",
    f""", y AS (SELECT id, q, known_date, value FROM stmt WHERE type = 'cost')
    SELECT b.id, b.d, {R4("y.value::DOUBLE / b.close / 100000::DOUBLE")} AS yield FROM sbars b ASOF LEFT JOIN y ON b.id = y.id AND b.d >= y.known_date""",
)
def asof_yield(p):
    met = asof_join(p.sbars.select("id", "d", "close"), p.stmt.where("type = 'cost'").drop("type"), ["id"], "d", "known_date")
    return met.select("id", "d", r4(F.col("value").cast("double") / F.col("close") / 100000.0).alias("yield"))


@query(
    "asof_stale",
    """, w AS (SELECT id, d, cents FROM bars WHERE DAYOFWEEK(d) = 1)
    SELECT b.id, b.d, CASE WHEN b.d - w.d <= 10 THEN w.cents END AS cents FROM bars b ASOF LEFT JOIN w ON b.id = w.id AND b.d >= w.d""",
)
def asof_stale(p):
    weekly = p.bars.where(F.dayofweek("d") == 2).select("id", F.col("d").alias("known"), "cents")
    return asof_join(p.bars.select("id", "d"), weekly, ["id"], "d", "known", 10).select("id", "d", "cents")


@query("panel_join", "SELECT b.id, b.d, b.cents, f.fnet, f.tnet, u.net FROM bars b LEFT JOIN flow f USING (id, d) LEFT JOIN ubars u USING (id, d)")
def panel_join(p):
    b = p.bars.select("id", "d", "cents")
    return b.join(p.flow.drop("volume"), ["id", "d"], "left").join(p.ubars.select("id", "d", "net"), ["id", "d"], "left")


@query("dim_join", "SELECT b.id, d, cents, name, industry FROM bars b LEFT JOIN dim ON dim.id = b.id")
def dim_join(p):
    return p.bars.select("id", "d", "cents").join(p.dim, "id", "left")


@query(
    "outer_ffill",
    """, j AS (SELECT COALESCE(b.id, r.id) AS id, COALESCE(b.d, r.known_date) AS d, b.cents, r.revenue FROM bars b FULL JOIN revm r ON b.id = r.id AND b.d = r.known_date)
    SELECT id, d, LAST_VALUE(cents IGNORE NULLS) OVER w AS cents, LAST_VALUE(revenue IGNORE NULLS) OVER w AS revenue FROM j WINDOW w AS (PARTITION BY id ORDER BY d ROWS UNBOUNDED PRECEDING)""",
)
def outer_ffill(p):
    both = p.bars.select("id", "d", "cents").join(p.revm.select("id", F.col("known_date").alias("d"), "revenue"), ["id", "d"], "full")
    return both.select("id", "d", S.filled("cents").alias("cents"), S.filled("revenue").alias("revenue"))


@query("parity_join", "SELECT id, d, cents, fnet FROM bars JOIN flow USING (id, d) WHERE fnet <> 0")
def parity_join(p):
    return p.bars.select("id", "d", "cents").join(p.flow.where("fnet <> 0").select("id", "d", "fnet"), ["id", "d"])


@query("yoy_month", f"SELECT a.id, a.m, a.revenue, {R4('a.revenue::DOUBLE / NULLIF(b.revenue, 0)::DOUBLE - 1::DOUBLE')} AS yoy FROM revm a LEFT JOIN revm b ON a.id = b.id AND b.m = a.m - INTERVAL 1 YEAR")
def yoy_month(p):
    r = p.revm.select("id", "m", "revenue")
    last = r.select("id", F.add_months("m", 12).alias("m"), F.col("revenue").alias("before"))
    return r.join(last, ["id", "m"], "left").select("id", "m", "revenue", r4(F.col("revenue").cast("double") / F.nullif(F.col("before").cast("double"), F.lit(0.0)) - 1).alias("yoy"))


@query(
    "yoy_nearest",
    """, s AS (SELECT id, d, cents FROM bars), c AS (
        SELECT a.id, a.d, a.cents, b.cents AS earlier, ROW_NUMBER() OVER (PARTITION BY a.id, a.d ORDER BY ABS(a.d - b.d - 365), b.d) AS n
        FROM s a LEFT JOIN s b ON a.id = b.id AND ABS(a.d - b.d - 365) <= 60)
    SELECT id, d, cents, earlier FROM c WHERE n = 1""",
)
def yoy_nearest(p):
    return nearest_join(p.bars.select("id", "d", "cents"), ["id"], "d", "cents")


@query(
    "t_plus_k",
    """, cal AS (SELECT d, ROW_NUMBER() OVER (ORDER BY d) AS i FROM (SELECT DISTINCT d FROM bars))
    SELECT b.id, b.d, b.cents, n.cents AS later FROM bars b JOIN cal c USING (d) LEFT JOIN (SELECT id, cents, i FROM bars JOIN cal USING (d)) n ON n.id = b.id AND n.i = c.i + 3""",
)
def t_plus_k(p):
    days = p.bars.select("d").distinct()
    cal = days.withColumn("i", F.row_number().over(Window.orderBy("d")))
    return shifted_join(p.bars.select("id", "d", "cents"), cal, ["id"], "d", "cents", 3, "later")


@query(
    "new_entrants",
    """, mon AS (SELECT DATE_TRUNC('month', d)::DATE AS m, id, SUM(cents) AS c FROM bars GROUP BY ALL), tops AS (SELECT m, id FROM mon QUALIFY ROW_NUMBER() OVER (PARTITION BY m ORDER BY c DESC, id) <= 5)
    SELECT m, id FROM tops a WHERE NOT EXISTS (SELECT 1 FROM tops b WHERE b.id = a.id AND b.m = a.m - INTERVAL 1 MONTH)""",
)
def new_entrants(p):
    month = p.bars.groupBy(F.trunc("d", "month").alias("m"), "id").agg(F.sum("cents").alias("c"))
    tops = month.withColumn("n", F.row_number().over(Window.partitionBy("m").orderBy(F.desc("c"), "id"))).where("n <= 5").select("m", "id")
    return tops.join(tops.select(F.add_months("m", 1).alias("m"), "id"), ["m", "id"], "left_anti")


@query(
    "dual_confirm",
    f""", r AS (SELECT id, d, close, volume, (RANK() OVER (PARTITION BY d ORDER BY close) + (COUNT(*) OVER (PARTITION BY d, close) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY d) * 100 AS a,
        (RANK() OVER (PARTITION BY d ORDER BY volume) + (COUNT(*) OVER (PARTITION BY d, volume) - 1) / 2.0::DOUBLE) / COUNT(*) OVER (PARTITION BY d) * 100 AS b FROM sbars)
    SELECT id, d, {R4("a")} AS a, {R4("b")} AS b FROM r WHERE a >= 80 AND b >= 80""",
)
def dual_confirm(p):
    r = p.sbars.select("id", "d", pct_rank("close", "d").alias("a"), pct_rank("volume", "d").alias("b"))
    return r.where("a >= 80 AND b >= 80").select("id", "d", r4(F.col("a")).alias("a"), r4(F.col("b")).alias("b"))


@query("latest_row", "SELECT id, d, cents FROM bars QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) = 1")
def latest(p):
    return latest_row(p.bars.select("id", "d", "cents"), ["id"], F.desc("d"))


@query("percent_rank", "SELECT id, d, FLOOR(PERCENT_RANK() OVER (PARTITION BY d ORDER BY close) * 1000::DOUBLE + 0.5::DOUBLE)::BIGINT::DOUBLE / 10::DOUBLE AS pr FROM sbars")
def percent_rank(p):
    return p.sbars.select("id", "d", r4(F.percent_rank().over(Window.partitionBy("d").orderBy("close")) * 100, 1).alias("pr"))


@query("universe_info", "SELECT COUNT(*) AS n, COUNT(DISTINCT id) AS ids, MAX(d) AS last, MIN(d) AS first FROM bars")
def universe_info(p):
    return p.bars.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("d").alias("last"), F.min("d").alias("first"))


@query("distinct_asof", "SELECT DISTINCT DATE_TRUNC('month', d)::DATE AS as_of FROM bars")
def distinct_asof(p):
    return p.bars.select(F.trunc("d", "month").alias("as_of")).distinct()


@query("arg_max_name", "SELECT industry, ARG_MAX(name, id) AS name FROM dim GROUP BY industry")
def arg_max_name(p):
    return p.dim.groupBy("industry").agg(F.max_by("name", "id").alias("name"))


@query("coverage_audit", "SELECT 'bars' AS dataset, COUNT(*) AS n, COUNT(*) FILTER (n = 1) AS thin, MIN(d) AS first, MAX(d) AS last FROM bars UNION ALL SELECT 'revm', COUNT(*), COUNT(*) FILTER (revenue IS NULL), MIN(m), MAX(m) FROM revm")
def coverage_audit(p):
    of = lambda rows, name, bad, day: rows.agg(F.lit(name).alias("dataset"), F.count("*").alias("n"), F.count_if(F.expr(bad)).alias("thin"), F.min(day).alias("first"), F.max(day).alias("last"))
    return of(p.bars, "bars", "n = 1", "d").unionByName(of(p.revm, "revm", "revenue IS NULL", "m"))


@query("dq_guard", f"SELECT d, COUNT(*) AS n, {R4('AVG((fnet = 0)::INT)')} AS empty_share FROM flow GROUP BY d HAVING AVG((fnet = 0)::INT) > 0.2 OR COUNT(*) < 3")
def dq_guard(p):
    day = p.flow.groupBy("d").agg(F.count("*").alias("n"), F.avg((F.col("fnet") == 0).cast("int")).alias("empty_share"))
    return day.where("empty_share > 0.2 OR n < 3").select("d", "n", r4(F.col("empty_share")).alias("empty_share"))


@query("stale_gate", "SELECT id, MAX(d) AS last, DATE '2001-11-04' - MAX(d) > 10 AS stale FROM bars GROUP BY id")
def stale_gate(p):
    return p.bars.groupBy("id").agg(F.max("d").alias("last")).select("id", "last", (F.datediff(F.lit("2001-11-04").cast("date"), "last") > 10).alias("stale"))


@query("first_seen", "SELECT user_id, event_type, MIN(ts) AS first FROM events GROUP BY ALL")
def first_seen(p):
    return p.table("events").groupBy("user_id", "event_type").agg(F.min("ts").alias("first"))


@query("price_on", "SELECT c.d, s.id, s.close FROM (SELECT DISTINCT LAST_DAY(d) AS d FROM sbars) c CROSS JOIN (SELECT DISTINCT id FROM sbars) i ASOF JOIN sbars s ON s.id = i.id AND c.d >= s.d")
def price_on(p):
    s = p.sbars.select("id", "d", "close")
    # each entity's own months, from its first day on, of those that any entity has
    months = s.groupBy(F.last_day("d").alias("at")).agg(F.max("d").alias("_d")).select("at")
    last = months.agg(F.max("at").alias("_last"))
    own = s.groupBy("id").agg(F.min("d").alias("_first")).join(F.broadcast(last))
    own = own.select("id", F.explode(F.sequence(F.trunc("_first", "month"), F.col("_last"), F.expr("INTERVAL 1 MONTH"))).alias("_m")).select("id", F.last_day("_m").alias("at"))
    ends = own.join(F.broadcast(months), "at", "left_semi")
    return asof_join(ends, s.withColumnRenamed("d", "known"), ["id"], "at", "known").where("close IS NOT NULL").select(F.col("at").alias("d"), "id", "close")


@query("calendar", "SELECT d, COUNT(*) AS n FROM sbars GROUP BY d HAVING COUNT(*) >= 5")
def calendar(p):
    return p.sbars.groupBy("d").agg(F.count("*").alias("n")).where("n >= 5")


@query("net_to_gross", "SELECT id, d, 'foreign' AS name, GREATEST(fnet, 0) AS buy, GREATEST(-fnet, 0) AS sell FROM flow UNION ALL SELECT id, d, 'trust', GREATEST(tnet, 0), GREATEST(-tnet, 0) FROM flow")
def net_to_gross(p):
    long = p.flow.select("id", "d", F.col("fnet").alias("foreign"), F.col("tnet").alias("trust")).unpivot(["id", "d"], ["foreign", "trust"], "name", "net")
    zero = F.lit(0).cast("long")
    return long.select("id", "d", "name", F.greatest("net", zero).alias("buy"), F.greatest(-F.col("net"), zero).alias("sell"))


@query("eav_latest", "SELECT id, COALESCE(ARG_MAX(value, q) FILTER (type = 'net'), ARG_MAX(value, q) FILTER (CONTAINS(type, 'gro'))) AS value FROM stmt GROUP BY id")
def eav_latest(p):
    of = lambda cond: F.max_by(F.when(cond, F.col("value")), F.when(cond, F.col("q")))
    return p.stmt.groupBy("id").agg(F.coalesce(of(F.col("type") == "net"), of(F.col("type").contains("gro"))).alias("value"))


@query("eav_series", "SELECT id, q, CAST(REPLACE(FORMAT('{:,}', value), ',', '') AS DOUBLE) AS value FROM stmt WHERE type = 'gross'")
def eav_series(p):
    return p.stmt.where("type = 'gross'").select("id", "q", F.expr("try_cast(replace(format_number(value, 0), ',', '') AS DOUBLE)").alias("value"))


@query("exposure_json", "SELECT d, to_json({'n': n, 'ids': ids}) AS snapshot FROM (SELECT d, COUNT(*) AS n, LIST(id ORDER BY id) AS ids FROM sbars GROUP BY d)")
def exposure_json(p):
    day = p.sbars.groupBy("d").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
    return day.select("d", F.to_json(F.struct("n", "ids")).alias("snapshot"))


@query("latest_yoy", f""", y AS (SELECT a.id, a.m, a.known_date, a.revenue::DOUBLE / NULLIF(b.revenue, 0)::DOUBLE - 1::DOUBLE AS yoy FROM revm a LEFT JOIN revm b ON a.id = b.id AND b.m = a.m - INTERVAL 1 YEAR)
    SELECT id, m, {R4("yoy")} AS yoy FROM y WHERE known_date <= DATE '2000-06-15' QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY m DESC) = 1""")  # fmt: skip
def latest_yoy(p):
    r = p.revm
    y = r.join(r.select("id", F.add_months("m", 12).alias("m"), F.col("revenue").alias("before")), ["id", "m"], "left")
    y = y.where("known_date <= DATE '2000-06-15'").withColumn("yoy", F.col("revenue").cast("double") / F.nullif(F.col("before").cast("double"), F.lit(0.0)) - 1)
    return latest_row(y, ["id"], F.desc("m")).select("id", "m", r4(F.col("yoy")).alias("yoy"))
