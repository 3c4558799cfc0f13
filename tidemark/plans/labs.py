"""Studies of the funnel and of ranks within industries, by era and over all of them, each in one pass."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import folded, mean_of_present
from tidemark.functions.ranks import grouped_pct_rank, pct_rank

from .base import R4, query, r4
from .factors import _ERA_SQL, FUNNEL, SCORED, eras, funnel, scored
from .technicals import avg_rank_sql

#: Floors of the mean volume: half the screen's, the screen's and twice it. Days with fewer rows, and pools with fewer, aren't judged.
FLOORS, LEAST_DAY, LEAST_POOL = (14, 28, 56), 10, 6
#: Shares of a day from which a return is a winner's and a composite stays, and the place of a price from which it must grow: fixed values.
WINNER, KEEP, DEAR = 90, 40, 90


def by_era(p, rows, *by):
    """rows (d) of the eras, grouped by `by` and the era, and by `by` alone (era `all`): to be aggregated."""
    held = rows.join(eras(p), F.expr("d BETWEEN a AND z"))
    keys = [F.col(c) for c in (*by, "era")]
    return held.groupingSets([keys, keys[:-1]], *keys)


def pools(p):
    """Of each floor and level (1 investable, 2 no trap, 3 not in the lowest composites), the rows that are still in, with the day's figures: floor, d, level, fwd, winner, winners, market, capped."""
    day = Window.partitionBy("d")
    rows = funnel(p).where("fwd IS NOT NULL").select("id", "d", "fwd", "bias", "mom", "volume", "yoy", "adv20", "first")
    rows = rows.withColumns({"winner": (pct_rank("fwd", "d") > WINNER).cast("int"), "market": F.avg("fwd").over(day), "_n": F.count("*").over(day)}).withColumn("winners", F.sum("winner").over(day)).where(f"_n >= {LEAST_DAY}")
    rows = rows.withColumn("floor", F.explode(F.array(*map(F.lit, FLOORS)))).where("adv20 >= floor AND DATEDIFF(d, first) >= 365")
    rows = rows.withColumns({"_v": pct_rank("bias", "floor", "d"), "_m": pct_rank("mom", "floor", "d"), "_c": pct_rank("volume", "floor", "d")})
    rows = rows.withColumns({"composite": mean_of_present(F.col("_v"), F.col("_m"), F.col("_c")), "capped": (folded(F.col("_v"), 80.0) + F.col("_m") + F.col("_c")) / 3})
    trap = F.coalesce(F.col("_v") > DEAR, F.lit(False)) & ~F.coalesce(F.col("yoy") > 0, F.lit(False))
    rows = rows.withColumn("_in", ~trap)
    rank = pct_rank("composite", "floor", "d", "_in")
    depth = F.when(~F.col("_in"), 1).when(F.coalesce(rank > KEEP, F.lit(False)), 3).otherwise(2)
    rows = rows.withColumn("_depth", depth)
    return rows.select("floor", "d", "id", "fwd", "winner", "winners", "market", "capped", F.explode(F.sequence(F.lit(1), F.col("_depth"))).alias("level"))


_POOLS = FUNNEL + f""", {_ERA_SQL}, pb0 AS (SELECT *, ({avg_rank_sql("fwd", "d")} > {WINNER})::INT AS winner, AVG(fwd) OVER (PARTITION BY d) AS market, COUNT(*) OVER (PARTITION BY d) AS n_day FROM fun WHERE fwd IS NOT NULL),
    pb1 AS (SELECT *, SUM(winner) OVER (PARTITION BY d) AS winners FROM pb0), pb2 AS (SELECT x.*, floor FROM pb1 x, (VALUES {", ".join(f"({x})" for x in FLOORS)}) f(floor) WHERE n_day >= {LEAST_DAY} AND adv20 >= floor AND d - first >= 365),
    pb3 AS (SELECT *, {avg_rank_sql("bias", "floor, d")} AS v, {avg_rank_sql("mom", "floor, d")} AS m, {avg_rank_sql("volume", "floor, d")} AS c FROM pb2),
    pb4 AS (SELECT *, (COALESCE(v, 0) + COALESCE(m, 0) + COALESCE(c, 0)) / NULLIF((v IS NOT NULL)::INT + (m IS NOT NULL)::INT + (c IS NOT NULL)::INT, 0)::DOUBLE AS composite, (CASE WHEN v <= 80 THEN v ELSE 160 - v END + m + c) / 3 AS capped, NOT (COALESCE(v > {DEAR}, false) AND NOT COALESCE(yoy > 0, false)) AS ok FROM pb3),
    pb5 AS (SELECT *, CASE WHEN NOT ok THEN 1 WHEN COALESCE({avg_rank_sql("composite", "floor, d, ok")} > {KEEP}, false) THEN 3 ELSE 2 END AS depth FROM pb4),
    pool AS (SELECT pb5.*, level FROM pb5, (VALUES (1), (2), (3)) l(level) WHERE level <= depth)"""


@query("funnel_sensitivity", _POOLS + f""", ds AS (SELECT floor, level, d, COUNT(*) AS n, SUM(winner)::DOUBLE / GREATEST(MAX(winners), 1) AS recall, AVG(fwd) - MAX(market) AS excess FROM pool GROUP BY ALL)
    SELECT floor, level, COALESCE(era, 'all') AS era, COUNT(*) AS days, {R4('AVG(n)')} AS kept, {R4('AVG(recall)')} AS recall, {R4('AVG(excess)')} AS excess FROM ds JOIN eras ON d BETWEEN a AND z GROUP BY GROUPING SETS ((floor, level, era), (floor, level))""")
def funnel_sensitivity(p):
    """What each floor leaves at each level: rows, share of the winners and excess over the market, by era and in all."""
    day = pools(p).groupBy("floor", "level", "d").agg(F.count("*").alias("n"), (F.sum("winner") / F.greatest(F.max("winners"), F.lit(1))).alias("recall"), (F.avg("fwd") - F.max("market")).alias("excess"))
    out = by_era(p, day, "floor", "level").agg(F.count("*").alias("days"), *[r4(F.avg(c)).alias(name) for c, name in (("n", "kept"), ("recall", "recall"), ("excess", "excess"))])
    return out.withColumn("era", F.coalesce("era", F.lit("all"))).select("floor", "level", "era", "days", "kept", "recall", "excess")


@query("pool_spread", _POOLS + f""", ls AS (SELECT floor, d, fwd, ROW_NUMBER() OVER (PARTITION BY floor, d ORDER BY capped, id) AS r, COUNT(*) OVER (PARTITION BY floor, d) AS n FROM pool WHERE level = 3 AND capped IS NOT NULL),
    ld AS (SELECT floor, d, AVG(fwd) FILTER (r > n - n // 3) - AVG(fwd) FILTER (r <= n // 3) AS spread FROM ls WHERE n >= {LEAST_POOL} GROUP BY ALL)
    SELECT floor, COALESCE(era, 'all') AS era, COUNT(*) AS days, {R4('AVG(spread)')} AS spread FROM ld JOIN eras ON d BETWEEN a AND z GROUP BY GROUPING SETS ((floor, era), (floor))""")
def pool_spread(p):
    """How the capped composite still orders the last pool: its upper third less its lower third."""
    w = Window.partitionBy("floor", "d")
    last = pools(p).where("level = 3 AND capped IS NOT NULL").withColumns({"_r": F.row_number().over(w.orderBy("capped", "id")), "_n": F.count("*").over(w)}).where(f"_n >= {LEAST_POOL}")
    third = F.floor(F.col("_n") / 3)
    day = last.groupBy("floor", "d").agg((F.avg(F.when(F.col("_r") > F.col("_n") - third, F.col("fwd"))) - F.avg(F.when(F.col("_r") <= third, F.col("fwd")))).alias("spread"))
    out = by_era(p, day, "floor").agg(F.count("*").alias("days"), r4(F.avg("spread")).alias("spread"))
    return out.withColumn("era", F.coalesce("era", F.lit("all"))).select("floor", "era", "days", "spread")


#: An entity's groups, from coarse to fine: the region, the industry and the industry's larger and smaller names.
LEVELS = ("region", "industry", "part")


def levels(p):
    """id, region and part of each entity."""
    s, n = p.table("supplier"), p.table("nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("region"), (F.col("s_nationkey") * 2 + (F.col("s_acctbal") >= 5000).cast("int")).alias("part"))


def _within(level):
    return f"CASE WHEN COUNT(pb) OVER (PARTITION BY d, {level}) >= 5 THEN {avg_rank_sql('pb', f'd, {level}')} ELSE {avg_rank_sql('pb', 'd')} END"


@query("decile_levels", SCORED + f""", {_ERA_SQL}, lv AS (SELECT s_suppkey AS id, n_regionkey AS region, s_nationkey * 2 + (s_acctbal >= 5000)::INT AS part FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    dl0 AS (SELECT s.*, region, part, fwd - AVG(fwd) OVER (PARTITION BY d) AS excess, COUNT(*) OVER (PARTITION BY d) AS n_day FROM scored s JOIN lv USING (id) WHERE fwd IS NOT NULL),
    dl1 AS (SELECT d, excess, pb AS market, {", ".join(f"{_within(x)} AS {x}" for x in LEVELS)} FROM (SELECT * FROM dl0 WHERE n_day >= {LEAST_DAY})),
    dl2 AS (UNPIVOT (SELECT d, excess, market, {", ".join(f"{x} AS w_{x}" for x in LEVELS)} FROM dl1) ON market, {", ".join(f"w_{x}" for x in LEVELS)} INTO NAME ranked VALUE v),
    dl3 AS (SELECT REPLACE(ranked, 'w_', '') AS ranked, d, AVG(excess) AS x FROM (SELECT *, {avg_rank_sql("v", "ranked, d")} AS r FROM dl2) WHERE r > 90 GROUP BY ALL)
    SELECT ranked, COALESCE(era, 'all') AS era, COUNT(*) AS days, {R4('AVG(x)')} AS excess FROM dl3 JOIN eras ON d BETWEEN a AND z GROUP BY GROUPING SETS ((ranked, era), (ranked))""")  # fmt: skip
def decile_levels(p):
    """Excess of the cheapest decile when prices are ranked in the whole market, or within groups of three levels (in the market where a group is small)."""
    day = Window.partitionBy("d")
    rows = scored(p).where("fwd IS NOT NULL").join(F.broadcast(levels(p)), "id").withColumns({"excess": F.col("fwd") - F.avg("fwd").over(day), "_n": F.count("*").over(day)}).where(f"_n >= {LEAST_DAY}")
    ranks = rows.select("d", "excess", F.col("pb").alias("market"), *[grouped_pct_rank("pb", "d", x).alias(x) for x in LEVELS])
    long = ranks.unpivot(["d", "excess"], ["market", *LEVELS], "ranked", "v").where("v IS NOT NULL")
    top = long.withColumn("_r", pct_rank("v", "ranked", "d")).where("_r > 90").groupBy("ranked", "d").agg(F.avg("excess").alias("x"))
    out = by_era(p, top, "ranked").agg(F.count("*").alias("days"), r4(F.avg("x")).alias("excess"))
    return out.withColumn("era", F.coalesce("era", F.lit("all"))).select("ranked", "era", "days", "excess")
