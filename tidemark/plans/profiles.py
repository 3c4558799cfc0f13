"""Volume profiles at month ends, and the trade plan that reads them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores as R
from tidemark.operators import technical as T
from tidemark.operators.profile import volume_profiles
from tidemark.operators.windows import Series, latest_row

from .base import R4, query, r4
from .technicals import _TR, P, roll

S = Series()
_ENDS = "SELECT MAX(d) FROM sbars GROUP BY DATE_TRUNC('month', d)"


def profile_sql(chosen: str) -> str:
    """Common table expressions up to `prof`: the profile of each row of sbars that fits the condition."""
    return f""", vb AS (SELECT *, close / LAG(close) OVER w AS j, {_TR} AS tr FROM sbars WINDOW w AS ({P})),
    vc AS (SELECT id, d, t, close, volume, SUM(CASE WHEN j < 0.7 OR j > 1.5 THEN LN(j) ELSE 0 END) OVER ({P}) AS scale,
        ROUND_EVEN(LEAST(GREATEST(GREATEST(COALESCE({roll("STDDEV_SAMP", "j - 1", 90, 3)}, 0) * 100, AVG(tr) OVER ({P} ROWS 13 PRECEDING) / close * 100) * 15::DOUBLE, 15), 45), 1) AS band FROM vb),
    ve AS (SELECT n.id, n.d, n.close AS cur, n.band, b.close * EXP(n.scale - b.scale) AS p, b.volume FROM vc n JOIN vc b ON b.id = n.id AND b.t BETWEEN n.t - 89 AND n.t WHERE {chosen}),
    vg AS (SELECT *, MIN(p) OVER k AS lo, (MAX(p) OVER k - MIN(p) OVER k) / 30 AS w, COUNT(*) OVER k AS n FROM ve WINDOW k AS (PARTITION BY id, d)),
    vn AS (SELECT id, d, cur, band, lo, w, n, LEAST(29, FLOOR((p - lo) / w)::INT) AS bin, SUM(volume)::BIGINT AS v FROM vg WHERE n >= 30 AND w > 0 GROUP BY ALL),
    vr AS (SELECT *, COALESCE(SUM(v) OVER (PARTITION BY id, d ORDER BY v DESC, bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(v) OVER (PARTITION BY id, d) AS total, MAX(v) OVER (PARTITION BY id, d) AS top FROM vn),
    vs AS (SELECT id, d, cur, band, lo, w, n, total, top, MIN(bin) FILTER (v = top) AS p, MIN(bin) FILTER (before < total * 0.7::DOUBLE) AS a, MAX(bin) FILTER (before < total * 0.7::DOUBLE) AS z,
        LIST(bin ORDER BY v DESC, bin) FILTER (v >= top * 0.25::DOUBLE) AS high, LIST(bin) FILTER (v > top * 0.1::DOUBLE) AS busy FROM vr WHERE total > 0 GROUP BY ALL),
    vt AS (SELECT *, lo + (p + 0.5::DOUBLE) * w AS poc, lo + (a + 0.5::DOUBLE) * w AS val, lo + (z + 0.5::DOUBLE) * w AS vah, lo + LEAST(29, FLOOR((cur - lo) / w)::INT) * w AS edge, LIST_TRANSFORM(high, LAMBDA b: lo + (b + 0.5::DOUBLE) * w) AS levels, LIST_FILTER(RANGE(30), LAMBDA b: NOT LIST_CONTAINS(busy, b)) AS low FROM vs),
    vu AS (SELECT *, (cur - poc) / poc * 100 AS distance, LIST_MAX(LIST_FILTER(levels, LAMBDA x: x <= cur)) AS standing FROM vt),
    vw AS (SELECT *, CASE WHEN (cur > poc AND distance >= band) OR cur > vah THEN 'above' WHEN cur < val THEN 'below' WHEN cur > poc AND distance >= ROUND_EVEN(GREATEST(LEAST(band * 0.4::DOUBLE, 25), 10), 1) THEN 'strong' ELSE 'inside' END AS status FROM vu),
    prof AS (SELECT id, d, cur, ROUND_EVEN(poc, 2) AS poc, ROUND_EVEN(val, 2) AS val, ROUND_EVEN(vah, 2) AS vah, distance, status, high, low,
        ROUND_EVEN(CASE status WHEN 'above' THEN LIST_MAX(LIST_FILTER(levels, LAMBDA x: x < edge)) WHEN 'strong' THEN standing ELSE CASE WHEN poc <= cur THEN poc ELSE standing END END, 2) AS support,
        ROUND_EVEN(LIST_MIN(LIST_FILTER(levels, LAMBDA x: x > GREATEST(edge + w, cur * 1.005::DOUBLE))), 2) AS resistance, ROUND_EVEN(LEAST(100, 60 * LEAST(1, n / 90::DOUBLE) + 40 * LEAST(top / total * 30 / 3::DOUBLE, 1)), 0) AS confidence FROM vw)"""


@query(
    "volume_nodes",
    profile_sql(f"n.d IN ({_ENDS})") + f" SELECT id, d, poc, val, vah, {R4('distance')} AS distance, status, support, resistance, ARRAY_TO_STRING(high, ',') AS high_nodes, ARRAY_TO_STRING(low, ',') AS low_nodes, confidence::DOUBLE AS confidence FROM prof",
)
def volume_nodes(p):
    """The whole profile of every entity at each month's last trading day."""
    ends = F.broadcast(p.sbars.groupBy(F.trunc("d", "month").alias("_m")).agg(F.max("d").alias("d")).select("d", F.lit(True).alias("_end")))
    found = volume_profiles(p.sbars.join(ends, "d", "left"), F.col("_end"))
    text = lambda c: F.array_join(F.transform(c, lambda b: b.cast("string")), ",")
    return found.select("id", "d", "poc", "val", "vah", r4(F.col("distance")).alias("distance"), "status", "support", "resistance", text("high_nodes").alias("high_nodes"), text("low_nodes").alias("low_nodes"), "confidence")


@query("trade_plan", profile_sql("n.t = (SELECT MAX(x.t) FROM vc x WHERE x.id = n.id)") + f""", tr AS (SELECT id, d, close, {_TR} AS tr, {roll("AVG", "close", 20, 1)} AS ma20 FROM sbars WINDOW w AS (PARTITION BY id ORDER BY d)),
    a AS (SELECT tr.*, AVG(tr) OVER ({P} ROWS 13 PRECEDING) AS atr FROM tr), l0 AS (SELECT a.*, poc, val, vah, support, resistance FROM a LEFT JOIN (SELECT * EXCLUDE (d) FROM prof) USING (id) QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY d DESC) = 1),
    h AS (SELECT *, COALESCE(LEAST(CASE WHEN poc >= close * 0.75 AND poc <= close * 1.02 THEN poc END, CASE WHEN ma20 <= close * 1.02 THEN ma20 END), close - 0.5 * atr) AS eh FROM l0),
    l AS (SELECT *, COALESCE(GREATEST(CASE WHEN val >= close * 0.75 AND val < eh THEN val END, CASE WHEN support >= close * 0.75 AND support < eh THEN support END), eh - 1.5 * atr) AS el, GREATEST(COALESCE(CASE WHEN vah > close THEN vah END, CASE WHEN resistance > close THEN resistance END, close + 2 * atr), close + atr) AS tg FROM h),
    s AS (SELECT *, CASE WHEN el - 1.5 * atr > 0 THEN el - 1.5 * atr ELSE el * 0.95 END AS st, CASE WHEN tg <= eh THEN eh + 2 * atr ELSE tg END AS t1, (close - eh) / eh * 100 AS dist, close <= eh * 1.005 AS zone FROM l)
    SELECT id, d, {R4("el", 2)} AS entry_low, {R4("eh", 2)} AS entry_high, {R4("st", 2)} AS stop, {R4("t1", 2)} AS target1, {R4("CASE WHEN eh > st THEN eh + 2 * (eh - st) END", 2)} AS target2, {R4("dist", 1)} AS distance, zone AS in_zone, {R4("CASE WHEN eh > st THEN (t1 - eh) / (eh - st) END", 2)} AS rr,
        CASE WHEN zone AND dist <= -3 THEN 'below_the_zone' WHEN zone THEN 'in_the_zone' WHEN dist <= 4 THEN 'just_above' ELSE 'too_high' END AS note FROM s""")  # fmt: skip
def trade_plan(p):
    """From the whole profile of each entity's last bar, the mean and the true range."""
    last = F.lead("d").over(Window.partitionBy("id").orderBy("d")).isNull()
    profile = volume_profiles(p.sbars.withColumn("_last", last), F.col("_last")).select("id", "poc", "val", "vah", "support", "resistance")
    rows = latest_row(T.atr(p.sbars).withColumn("ma20", S.mean("close", 20, 1)), ["id"], F.desc("d")).join(profile, "id", "left")
    for name, value in R.trade_plan().items():
        rows = rows.withColumn(name, value)
    places = {"entry_low": 2, "entry_high": 2, "stop": 2, "target1": 2, "target2": 2, "distance": 1, "rr": 2}
    return rows.select("id", "d", *[r4(F.col(c), n).alias(c) for c, n in places.items()], "in_zone", "note")
