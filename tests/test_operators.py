"""Operators against hand-made frames and pandas."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranks, scores
from tidemark.operators import factors, portfolio, regime, technical
from tidemark.operators.asof import asof_join, nearest_join
from tidemark.operators.windows import Series, debounced, expanding_pct
from tidemark.sources import store
from tidemark.streaming import events

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


def bars(spark, closes, entity=1):
    rows = [(entity, day(i), i + 1, c, c * 1.01, c * 0.99, c, 1000) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "id long, d date, t long, open double, high double, low double, close double, volume long")


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    return [float(x) for x in 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))]


def test_asof_takes_the_latest_fact_even_if_null(spark):
    probes = spark.createDataFrame([(1, day(k)) for k in (0, 5, 6, 20, 40)] + [(2, day(9))], "id long, d date")
    facts = spark.createDataFrame([(1, day(5), 1.0), (1, day(10), 2.0), (1, day(15), None), (3, day(0), 9.0)], "id long, known date, v double")
    got = {(r.id, r.d): r.v for r in asof_join(probes, facts, ["id"], "d", "known").collect()}
    assert got == {(1, day(0)): None, (1, day(5)): 1.0, (1, day(6)): 1.0, (1, day(20)): None, (1, day(40)): None, (2, day(9)): None}
    got = {r.d: r.known for r in asof_join(probes.where("id = 1"), facts, ["id"], "d", "known", 10).collect()}
    assert got == {day(0): None, day(5): day(5), day(6): day(5), day(20): day(15), day(40): None}


def test_nearest_takes_the_earlier_of_two(spark):
    rows = spark.createDataFrame([(1, day(0), 1), (1, day(10), 2), (1, day(370), 3), (1, day(500), 4)], "id long, d date, v int")
    got = {r.d: r.earlier for r in nearest_join(rows, ["id"], "d", "v").collect()}
    assert got == {day(0): None, day(10): None, day(370): 1, day(500): None}


def test_pct_rank_averages_ties_and_skips_nulls(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 2.0), (1, None)], "g int, v double")
    got = sorted((r.p for r in rows.select(ranks.pct_rank("v", "g").alias("p")).collect()), key=lambda x: (x is None, x))
    assert got[:3] == pytest.approx([100 / 3, 250 / 3, 250 / 3]) and got[3] is None


@pytest.mark.parametrize("n", [5, 7, 12, 33])
def test_bucketings(spark, n):
    rows = spark.range(1, n + 1).select(F.col("id").alias("r"), F.lit(n).alias("n"))
    got = rows.select("r", ranks.bucket_first(F.col("r"), F.col("n"), 5).alias("a"), ranks.bucket_share(F.col("r"), F.col("n"), 5).alias("b"), ranks.bucket_slice(F.col("r"), F.col("n"), 5).alias("c")).orderBy("r").collect()
    assert [r.a for r in got] == [int(x) + 1 for x in pd.qcut(pd.Series(range(n)).rank(method="first"), 5, labels=False)]
    assert [r.b for r in got] == [min(5, max(1, -(-r * 5 // n))) for r in range(1, n + 1)]
    cuts = np.linspace(0, n, 6).astype(int)
    assert [r.c for r in got] == [int(np.searchsorted(cuts, r, side="right") - 1) for r in range(n)]


def test_rolling_needs_values_and_tail_doesnt(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 2, None), (1, 3, 3.0)], "id int, d int, v double")
    s = Series()
    got = rows.select("d", s.mean("v", 3).alias("full"), s.mean("v", 3, 1).alias("any")).orderBy("d").collect()
    assert got[2].full is None and got[2].any == 2.0


def test_expanding_pct(spark):
    values = [5.0, -1.0, 3.0, None, 4.0, 10.0]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "id int, d int, v double")
    got = [r.pct for r in expanding_pct(rows, "id", "d", "v", 2).orderBy("d").collect()]
    assert got == [None, None, 0.0, None, pytest.approx(100 / 3), 75.0]


@pytest.mark.parametrize(("up", "down"), [(3, 3), (5, 1), (1, 1)])
def test_debounce_is_a_state_machine(spark, up, down):
    rng = random.Random(up * 10 + down)
    raw = [rng.random() < 0.5 for _ in range(200)]
    state, last, run, want = raw[0], None, 0, []
    for x in raw:
        run = run + 1 if x == last else 1
        last = x
        if run >= (up if x else down):
            state = x
        want.append(state)
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(raw)], "id int, d int, raw boolean")
    assert [r.state for r in debounced(rows, ["id"], "d", "raw", up, down).orderBy("d").collect()] == want


def test_indicators_are_those_of_pandas(spark):
    closes = walk(150)
    c = pd.Series(closes)
    b = bars(spark, closes)
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    got = technical.macd(b).orderBy("d").toPandas()
    assert np.allclose(got.macd, macd) and np.allclose(got.signal, macd.ewm(span=9, adjust=False).mean())
    step = c.diff()
    rsi = 100 - 100 / (1 + step.clip(lower=0).rolling(14).mean() / (-step).clip(lower=0).rolling(14).mean())
    assert np.allclose(technical.rsi(b).orderBy("d").toPandas().rsi.to_numpy(float), rsi, equal_nan=True)
    got = technical.bollinger(b).orderBy("d").toPandas()
    assert np.allclose(got.upper.to_numpy(float), c.rolling(20).mean() + 2 * c.rolling(20).std(), equal_nan=True)
    high, low = c * 1.01, c * 0.99
    tr = pd.concat([high - low, (high - c.shift()).abs(), (low - c.shift()).abs()], axis=1).max(axis=1)
    assert np.allclose(technical.atr(b).orderBy("d").toPandas().atr, tr.rolling(14, min_periods=1).mean())


def test_back_adjust_scales_the_past(spark):
    got = technical.back_adjusted(bars(spark, [100.0, 102.0, 51.0, 50.0, 100.0])).orderBy("d").collect()
    assert [r.adjusted for r in got] == pytest.approx([100.0, 102.0, 102.0, 100.0, 100.0])


def test_volume_profile_finds_the_crowd(spark):
    closes = [100.0] * 50 + [130.0] * 20 + [115.0] * 5
    got = technical.volume_profile(bars(spark, closes)).collect()[0]
    assert abs(got.poc - 100) < 1 and got.val <= got.poc <= got.vah
    assert technical.volume_profile(bars(spark, [100.0] * 40)).count() == 0


@pytest.mark.parametrize("feature", [technical.rsi, technical.macd, technical.bollinger, technical.kdj, technical.atr, technical.on_balance, technical.technical_panel])
def test_features_dont_see_the_future(spark, feature):
    closes = walk(100, 3)
    short = feature(bars(spark, closes[:80])).orderBy("d").toPandas()
    long = feature(bars(spark, closes)).orderBy("d").toPandas().iloc[:80]
    pd.testing.assert_frame_equal(short, long, check_exact=False, rtol=1e-9)


def test_regime_confirmation():
    assert regime.confirmed(["bull"] * 5)[-1] == "bull" and regime.confirmed(["bull"] * 4)[-1] == "neutral"
    assert regime.confirmed(["bear_fast"]) == ["bear"]
    assert regime.confirmed(["bear", "neutral", "bear"]) == ["neutral", "neutral", "bear"]
    assert regime.confirmed(["bear_fast"] + ["bull"] * 9)[-1] == "bear" and regime.confirmed(["bear_fast"] + ["bull"] * 10)[-1] == "bull"


def test_hysteresis_runs_each_entity(spark):
    rows = spark.createDataFrame([(i, day(k), "bull" if i == 1 else "bear") for i in (1, 2) for k in range(6)], "id long, d date, raw string")
    got = regime.hysteresis(rows).where(F.col("d") == F.lit(day(5))).collect()
    assert {r.id: r.regime for r in got} == {1: "bull", 2: "bear"}


def test_exits(spark):
    closes = [100.0, 110.0, 120.0, 100.0, 90.0, 91.0]
    b = bars(spark, closes)
    entry = lambda support, buffer: spark.createDataFrame([(1, 1, 100.0, support, buffer)], "id long, t0 long, close0 double, support double, buffer double")
    assert [(r.reason, r.t) for r in portfolio.exits(entry(95.0, 50.0), b).collect()] == [("support", 5)]
    assert [(r.reason, r.t) for r in portfolio.exits(entry(1.0, 10.0), b).collect()] == [("trailing", 4)]
    assert [(r.reason, r.t) for r in portfolio.exits(entry(1.0, 50.0), b, 3).collect()] == [("time", 4)]


def test_spaced_is_greedy(spark):
    rows = spark.createDataFrame([(1, x) for x in (1, 5, 21, 22, 41, 42, 60)], "id long, t long")
    assert sorted(r.t for r in portfolio.spaced(rows, "id", "t", 20).collect()) == [1, 21, 41]


def test_money_weighted_rate(spark):
    flows = spark.createDataFrame([("a", 0.0, -100.0), ("a", 1.0, 110.0)], "who string, i double, flow double")
    assert portfolio.money_weighted(flows, "who").collect()[0].rate == pytest.approx(0.1)


def test_bootstrap_is_seeded(spark):
    r = spark.createDataFrame([(i, 0.01 * (i % 5 - 2)) for i in range(40)], "i int, net double")
    a, b = (sorted(tuple(x) for x in portfolio.bootstrap(r, draws=50).collect()) for _ in range(2))
    assert a == b and len(a) == 50 and len({x[1] for x in a}) > 10


def test_low_correlation_pool(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.1), (2, 3, 0.2), (1, 4, 0.5), (2, 4, 0.5), (3, 4, 0.9)], "a long, b long, c double")
    assert portfolio.low_correlation_pool(pairs, [1, 2, 3, 4], 2) == [3, 1]


def test_rank_ic_is_spearman(spark):
    rng = np.random.default_rng(5)
    f = pd.DataFrame({"id": range(60), "d": [1, 2] * 30, "x": rng.integers(0, 9, 60).astype(float), "y": rng.normal(size=60)})
    got = {r.d: r.ic for r in factors.rank_ic(spark.createDataFrame(f), "x", "y", "d").collect()}
    for d, g in f.groupby("d"):
        assert got[d] == pytest.approx(g.x.rank().corr(g.y.rank()))


def test_scores_at_band_edges(spark):
    row = spark.createDataFrame([(100.0, 98.0, 95.0, 90.0, 55.0, "neutral", "none", "expanding", "neutral")], "close double, ma5 double, ma20 double, weekly_ma double, rsi double, macd_status string, cross string, bb_status string, ma_cross string")
    score = lambda **x: row.withColumns({k: F.lit(v) for k, v in x.items()}).select(scores.technical_score().alias("s")).first().s
    assert score() == 83 and score(rsi=70.5) == 73 and score(rsi=29.0) == 58 and score(ma_cross="death_cross") == 75 and score(macd_status="bullish_strong") == 95
    assert score(close=1.0, ma5=2.0, ma20=3.0, weekly_ma=0.0, rsi=10.0, macd_status="bearish", bb_status="x", ma_cross="death_cross") == 0
    peg = spark.createDataFrame([(x,) for x in (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 9.0)], "p double").select(scores.peg_score(F.col("p")).alias("s"))
    assert [r.s for r in peg.collect()] == pytest.approx([100, 100, 80, 67.5, 55, 35, 17.5, 0, 0])


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1)], "k int, v string, at int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert rows(store.upsert_first_seen(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(store.upsert_keep_last(old, new, ["k"], "at")) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.merge_by_priority(["k"], old, new)) == [(1, "a"), (2, "b"), (3, "d")]


def test_freeze_writes_once(spark, tmp_path):
    one, two = (spark.createDataFrame([(x,)], "id long") for x in (1, 2))
    store.freeze(one, str(tmp_path), "2024-01-01")
    store.freeze(two, str(tmp_path), "2024-01-01")
    assert [r.id for r in spark.read.parquet(str(tmp_path)).collect()] == [1]
    store.freeze(two, str(tmp_path), "2024-01-01", force=True)
    assert [r.id for r in spark.read.parquet(str(tmp_path)).collect()] == [2]


def test_positional_sheet(spark):
    sheet = spark.createDataFrame([("1101 One Co", "20240102", "1,234.5", "x"), (None, "20240102", "1", "x")], "a string, b string, c string, d string")
    got = store.positional(sheet, {0: "id", 1: "d", 2: "v"}, {"v"}, {"v"}, "id", "d", 4).collect()
    assert [(r.id, r.id_name, r.d, r.v) for r in got] == [("1101", "One Co", dt.date(2024, 1, 2), 1234500.0)]
    with pytest.raises(ValueError):
        store.positional(sheet, {0: "id"}, set(), set(), "id", "d", 5)


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_streamed_windows_equal_batch(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, at(h / 4), "click", 1.0) for h in range(40)] + [(2, at(300), "view", 2.0)]
    schema = "user_id long, ts timestamp_ntz, event_type string, value double"
    s = events.windowed(stream(spark, rows, schema, str(tmp_path / "in")), "1 hour")
    q = s.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.start, r.event_type, r.n) for r in spark.table("windows").collect())
    want = sorted((r.start, r.event_type, r.n) for r in events.windowed(spark.createDataFrame(rows, schema), "1 hour").where("event_type = 'click'").collect())
    assert got == want


def test_streamed_state(spark, tmp_path):
    rows = [(1, day(k), x) for k, x in enumerate([True, True, False, False, False, True])]
    s = events.confirmed_states(stream(spark, rows, "user_id long, day date, up boolean", str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.state for r in spark.table("states").orderBy("day").collect()] == [True, True, True, True, False, False]


def test_streamed_upsert(spark, tmp_path):
    write = events.upserted_to(str(tmp_path / "out"), ["k"])
    write(spark.createDataFrame([(1, "a"), (1, "a")], "k int, v string"), 0)
    write(spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "a"), (2, "c")]
