"""Point-in-time joins, pooled order and scores against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import scores as R
from tidemark.functions.ranks import pooled_rank, quantiles
from tidemark.operators import technical as T
from tidemark.operators.asof import asof_join, asof_joins
from tidemark.operators.windows import expanding_pct, runs
from tidemark.sources import readers

DAY = dt.date(2020, 1, 1)


def test_asof_joins_are_the_single_joins(spark):
    rng = random.Random(2)
    day = lambda: DAY + dt.timedelta(days=rng.randrange(60))
    probes = spark.createDataFrame([(i % 4, DAY + dt.timedelta(days=k), i) for i in range(4) for k in range(0, 60, 3)], "id long, d date, tag long")
    facts = [spark.createDataFrame(sorted({(i, day()): (i, d, v) for i in range(4) for d, v in ((day(), rng.choice([None, 1.5, 2.5])) for _ in range(5))}.values()), "id long, known date, v double").dropDuplicates(["id", "known"]) for _ in range(2)]
    facts = [spark.createDataFrame(f.collect(), f.schema) for f in facts]
    got = asof_joins(probes, {"a": (facts[0], "known"), "b": (facts[1], "known")}, ["id"], "d")
    want = asof_join(asof_join(probes, facts[0].withColumnsRenamed({"v": "va", "known": "ka"}), ["id"], "d", "ka"), facts[1].withColumnsRenamed({"v": "vb", "known": "kb"}), ["id"], "d", "kb")
    key = lambda r: (r[0], r[1])
    assert sorted(((r.id, r.d, r.tag, r.a and r.a.known, r.a and r.a.v, r.b and r.b.known, r.b and r.b.v) for r in got.collect()), key=key) == sorted(((r.id, r.d, r.tag, r.ka, r.va, r.kb, r.vb) for r in want.collect()), key=key)


def test_expanding_pct_counts_lower_values_so_far(spark):
    rng = random.Random(3)
    rows = [(i, k, rng.choice([None, -1.0, 0.0, *(float(rng.randrange(1, 30)) for _ in range(9))])) for i in range(3) for k in range((5, 64, 131)[i])]
    got = {(r.id, r.k): r.pct for r in expanding_pct(spark.createDataFrame(rows, "id long, k long, v double"), "id", "k", "v", 4).collect()}
    for i, k, v in rows:
        known = [x for j, m, x in rows if j == i and m <= k and x is not None and x > 0]
        want = sum(x < v for x in known) * 100 / len(known) if v is not None and v > 0 and len(known) >= 4 else None
        assert got[i, k] == pytest.approx(want) if want is not None else got[i, k] is None


def test_pooled_order(spark):
    rng = np.random.default_rng(4)
    values = [*map(float, rng.normal(0, 3, 200).round(1)), -7.25, 9.5]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, v double")
    order = {i: k + 1 for k, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert {r.id: (r._r, r._n) for r in pooled_rank(rows, "v", 0.5, "id").collect()} == {i: (k, len(values)) for i, k in order.items()}
    shares = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.93, "e": 1.0}
    got = quantiles(rows.unionByName(spark.createDataFrame([(999, None)], "id long, v double")), "v", shares, 0.5).first()
    assert {k: got[k] for k in shares} == pytest.approx({k: float(np.quantile(values, q)) for k, q in shares.items()})


def test_runs_restart_at_breaks(spark):
    flags = [False, True, False, False, True, True, False]
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(flags)], "id long, i long, b boolean")
    assert [r.run for r in runs(rows, ["id"], "i", F.col("b")).orderBy("i").collect()] == [1, 1, 2, 3, 1, 1, 2]


def test_weekly_mean_takes_the_day_for_its_week(spark):
    days = [(1, DAY + dt.timedelta(days=k), 10.0 + k) for k in (0, 1, 5, 8, 30)]
    got = {r.d: r.weekly_ma for r in T.weekly_as_of(spark.createDataFrame(days, "id long, d date, close double"), 3).collect()}
    # weeks of Monday 30 Dec (two days), 6 Jan (two days), 13 and 20 Jan (empty: carried over), 27 Jan
    assert got == pytest.approx({days[0][1]: 10, days[1][1]: 11, days[2][1]: (15 + 11) / 2, days[3][1]: (18 + 11) / 2, days[4][1]: (40 + 18 + 18) / 3})


def scored(spark, fn, **fields):
    base = {"close": 10.0, "m6": 0.0, "m3": 0.0, "rs6": None, "rs3": None, "accel": None, "cum_yoy": None, "rev_streak": 0, "volume": 1000, "spike": 1.5, "bias": 2.0, "divergence": False, "obv_rising": False, "j": 50.0}
    base |= {"foreign": {}, "trust": {}, "fbuy": 0, "tbuy": 0, "fsell": 0, "tsell": 0, "concentration": 0.0, "participation": 0.0, "flow_accel": 1.0, "up_volume": 50.0, "holders_change": 0.0, "net5": 0.0, "fflow": 0.0, "tflow": 0.0, "technical": 0.0, "whale": 0.0}
    base |= fields
    kinds = {"foreign": "map<int,double>", "trust": "map<int,double>", "divergence": "boolean", "obv_rising": "boolean", "volume": "long", "rev_streak": "long", "fbuy": "long", "tbuy": "long", "fsell": "long", "tsell": "long"}
    return spark.createDataFrame([Row(**base)], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in base)).select(fn().alias("x")).first().x


@pytest.mark.parametrize(("spike", "points"), [(None, 4), (0.0, 4), (0.7, 0), (0.9, 4), (1.5, 7), (2.1, 10)])
def test_an_unknown_spike_counts_as_one(spark, spike, points):
    # six points for m6, three for m3 below zero, ten for the bias
    assert scored(spark, R.momentum_score, spike=spike, m6=-5.0, m3=-5.0) == 6 + 3 + 10 + points


def test_whale_score_without_ratios_goes_by_days(spark):
    assert scored(spark, R.whale_score, tbuy=2, fbuy=1) == 20 + 10 + 15
    assert scored(spark, R.whale_score, tbuy=9, tsell=1, net5=5.0, flow_accel=2.0, fflow=-1.0, tflow=3.0) == 50 - 8 + (8 - 4 + 4 + 5)
    assert scored(spark, R.whale_score, tbuy=3, net5=1.0, holders_change=-1.0) == 30 + 8 - 4 - 3
    assert scored(spark, R.whale_score, foreign={5: 0.1, 10: 0.1}, trust={5: 0.1}, up_volume=60.0) == pytest.approx(48 + 300 * 0.25 * 0.3 + 8 + 3)


def test_comment_tags(spark):
    assert scored(spark, R.comment_tags) == "consolidating"
    assert scored(spark, R.comment_tags, tbuy=2, fsell=1, technical=80.0) == "trust_buying+selling+averages_aligned"


def test_readers(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# names\n2330  First\n\n aa11 # Second one\n2330 again\nbare\n", encoding="utf-8")
    got = [(r.id, r.name) for r in readers.watchlist(spark, str(tmp_path / "list.txt")).orderBy("place").collect()]
    assert [g for g in got if g[0] != "BARE"] == [("2330", "First"), ("AA11", "Second")] and got[2][0] == "BARE"
    for y, rows in (("a", "2020/01/02,\"1,200.5\"\n2020/01/03,7\n"), ("b", "2020/01/03,8\n2020/01/06,x\n")):
        (tmp_path / f"{y}.csv").write_text("Trade Date, Close Price (x)\n" + rows, encoding="utf-8")
    names = {"d": ["date"], "close": ["closing", "closeprice"]}
    out = readers.yearly(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], names, "d", {"close"})
    assert sorted((r.d, r.close) for r in out.collect()) == [(dt.date(2020, 1, 2), 1200.5), (dt.date(2020, 1, 3), 8.0), (dt.date(2020, 1, 6), None)]
    with pytest.raises(ValueError, match="no column for volume"):
        readers.mapped_csv(spark, str(tmp_path / "a.csv"), names | {"volume": ["volume"]})
