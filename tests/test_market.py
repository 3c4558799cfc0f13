"""Pools of all names, valuations by history and industry, volume profiles: against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scores as R
from tidemark.operators import factors as X
from tidemark.operators.profile import volume_profiles
from tidemark.operators.windows import expanding_pcts
from tidemark.plans import catalogues, snapshot
from tidemark.plans.base import Panels

DAY = dt.date(2000, 1, 3)


def returns_of(bars):
    x = bars.toPandas().sort_values(["id", "d"])
    x["r"] = x.groupby("id").close.pct_change()
    return x.pivot(index="d", columns="id", values="r")


def greedy(wide, size, least=20):
    """The plain greedy choice; pairs without a correlation count as 1."""
    c = wide.corr(min_periods=least).fillna(1.0)
    names = sorted(c)
    chosen = [min(names, key=lambda n: (round(sum(c[n][m] for m in names if m != n), 9), n))]
    while len(chosen) < min(size, len(names)):
        chosen.append(min((n for n in names if n not in chosen), key=lambda n: (round(sum(c[n][m] for m in chosen), 9), n)))
    return chosen


def test_low_corr_pool_is_the_greedy_choice_over_all_entities(spark):
    p = Panels(spark, "/root/testdata/sf0.001")
    want = greedy(returns_of(p.sbars), 8)
    assert [(r.place, r.id) for r in catalogues.low_corr_pool(p).orderBy("place").collect()] == list(enumerate(want, 1))


def test_low_correlation_names_with_gaps(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(rng.normal(size=(60, 9)) @ rng.normal(size=(9, 9)), columns=range(9))
    wide[4] = np.where(np.arange(60) < 10, wide[4], np.nan)  # too few days with anyone
    wide[7] = 0.5  # doesn't vary
    rows = spark.createDataFrame([(int(n), int(d), None if math.isnan(v) else float(v)) for n in wide for d, v in wide[n].items()], "id long, d long, r double")
    for block in (2, 256):
        out = X.low_correlation_names(rows, 9, block=block).orderBy("place").collect()
        assert [r.id for r in out] == greedy(wide, 9)
    sums = {r.id: (r.pairs, r.known, r.total) for r in X.correlation_sums(rows, block=3).collect()}
    c = wide.corr(min_periods=20)
    for n in (0, 1, 8):
        known = [c[n][m] for m in wide if m != n and not math.isnan(c[n][m])]
        assert sums[n][1] == len(known) and sums[n][2] == pytest.approx(sum(known))
    assert X.low_correlation_names(rows.limit(0), 3).count() == 0


def test_random_pools_are_spreads_of_their_names(spark):
    p = Panels(spark, "/root/testdata/sf0.001")
    out = catalogues.random_pools(p, draws=3, size=7).collect()
    ids = [r.id for r in p.dim.select("id").collect()]
    order = {(r.draw, r.id): r.h for r in p.dim.select("id").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3)))).select("draw", "id", F.xxhash64(F.lit(7), "draw", "id").alias("h")).collect()}
    rows = catalogues.scored(p).where("fwd IS NOT NULL AND c2 IS NOT NULL").select("id", "d", "fwd", "c2").toPandas()
    want = {}
    for draw in (1, 2, 3):
        names = sorted(ids, key=lambda i: (order[draw, i], i))[:7]
        mine, days = rows[rows.id.isin(names)], {}
        for d, g in mine.groupby("d"):
            g = g.sort_values(["c2", "id"])
            k = math.floor(len(g) * 0.2)
            if k:
                days.setdefault(d.year, []).append(g.fwd.iloc[-k:].mean() - g.fwd.iloc[:k].mean())
        want |= {(draw, y): (len(v), np.mean(v)) for y, v in days.items()}
    assert want and {(r.draw, r.year): r.days for r in out} == {k: n for k, (n, _) in want.items()}
    assert {(r.draw, r.year): r.spread for r in out} == pytest.approx({k: m for k, (_, m) in want.items()}, abs=1e-4)


def test_expanding_percentiles_of_several_columns(spark):
    rng = random.Random(5)
    some = lambda: rng.choice([None, -1.0, 0.0, *(float(rng.randrange(1, 20)) for _ in range(6))])
    rows = [(i, k, some(), some(), "x") for i in range(3) for k in range((1, 70, 130)[i])]
    out = expanding_pcts(spark.createDataFrame(rows, "id long, k long, v double, w double, x string").repartition(3), "id", "k", {"a": ("v", True), "b": ("w", False)}, 5)
    assert out.columns == ["id", "k", "v", "w", "x", "a", "b"]
    got = {(r.id, r.k): r for r in out.collect()}
    assert len(got) == len(rows)
    for i, k, v, w, _ in rows:
        for name, value, at, ok in (("a", v, 2, lambda y: y is not None and y > 0), ("b", w, 3, lambda y: y is not None)):
            known = [r[at] for r in rows if r[0] == i and r[1] <= k and ok(r[at])]
            want = sum(y < value for y in known) * 100 / len(known) if ok(value) and len(known) >= 5 else None
            assert getattr(got[i, k], name) == (pytest.approx(want) if want is not None else None)


def test_valuation_ranks_are_quadratic_counts(spark):
    rng = random.Random(8)
    rows = [(i, DAY + dt.timedelta(days=k), i % 2 if i < 12 else 2, rng.choice([None, -3.0, *(float(rng.randrange(5, 40)) for _ in range(9))]), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([0.0, 1.0, 2.0])) for i in range(14) for k in range(75)]
    out = snapshot.valuation_ranks(spark.createDataFrame(rows, "id long, d date, industry int, pe double, pb double, dividend_yield double")).collect()
    own = {}
    for i, d, _, pe, *_ in rows:
        known = [r[3] for r in rows if r[0] == i and r[1] <= d and r[3] is not None and r[3] > 0]
        if pe is not None and pe > 0 and len(known) >= 60:
            own[i, d] = 100 - sum(x < pe for x in known) * 100 / len(known)
    of = {i: g for i, _, g, *_ in rows}

    def rank(i, d, among):
        x = own[i, d]
        values = [own[j, d] for j in among if (j, d) in own]
        return 100 * (sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2) / len(values)

    assert {r.industry for r in out if r.industry_pct is not None} == {0, 1, 2}
    for r in out:
        if (r.id, r.d) not in own:
            assert r.industry_pct is None
            continue
        peers = [j for j in of if of[j] == of[r.id]]
        enough = sum((j, r.d) in own for j in peers) >= 5
        assert r.industry_pct == pytest.approx(rank(r.id, r.d, peers if enough else list(of)))


def test_valuation_rests_on_what_is_known(spark):
    names = "pe pb ps dividend_yield growth pe_pct pb_pct yield_pct industry_pct cum_yoy".split()
    cases = [
        ((12.0, 1.0, 1.0, 3.0, 10.0, 30.0, 20.0, 60.0, 77.0, 5.0), "industry", 100.0, 77.0),
        ((12.0, 1.0, 1.0, 3.0, 10.0, 30.0, None, None, None, 5.0), "growth+history", 76.0, None),
        ((None, 1.0, 1.0, 3.0, None, None, 20.0, 60.0, None, None), "history", 88.0, (80 * 0.3 + 60 * 0.25) / 0.55),
        ((12.0, 2.4, None, 0.0, None, None, None, None, None, None), "absolute", 60.0, ((12 - 30) / (8 - 30) * 100 * 0.35 + (2.4 - 4) / (0.8 - 4) * 100 * 0.25) / 0.6),
        ((None,) * 10, "none", 20.0, None),
    ]
    rows = spark.createDataFrame([c[0] for c in cases], ", ".join(f"{n} double" for n in names)).select(R.valuation_basis().alias("basis"), R.valuation_confidence().alias("confidence"), F.coalesce(R.valuation_score(), R.absolute_valuation()).alias("val"))
    for r, (_, basis, confidence, val) in zip(rows.collect(), cases, strict=True):
        assert (r.basis, r.confidence) == (basis, confidence)
        assert val is None or r.val == pytest.approx(val)


def plain_profile(close, volume, band, window=90, bins=30):
    """The profile of the last bar, from the definition."""
    p, v = np.array(close[-window:], float), np.array(volume[-window:], float)
    factor = np.ones(len(p))
    for i in range(1, len(p)):
        if not 0.7 <= p[i] / p[i - 1] <= 1.5:
            factor[:i] *= p[i] / p[i - 1]
    p = p * factor
    if len(p) < 30 or p.max() <= p.min() or v.sum() <= 0:
        return None
    w = (p.max() - p.min()) / bins
    at = np.minimum(np.floor((p - p.min()) / w).astype(int), bins - 1)
    by = np.bincount(at, v, bins)
    centre = p.min() + (np.arange(bins) + 0.5) * w
    top = int(by.argmax())
    taken, acc = [], 0.0
    for b in sorted(range(bins), key=lambda b: (-by[b], -b)):
        if acc >= 0.7 * by.sum():
            break
        taken.append(b)
        acc += by[b]
    cur, poc, val, vah = p[-1], centre[top], centre[min(taken)], centre[max(taken)]
    far = (cur - poc) / poc * 100
    band = round(band, 1)
    strong = round(max(min(band * 0.4, 25), 10), 1)
    status = "above" if (cur > poc and far >= band) or cur > vah else "below" if cur < val else "strong" if cur > poc and far >= strong else "inside"
    high = [b for b in range(bins) if by[b] >= by[top] * 0.25]
    edge = p.min() + at[-1] * w
    under = lambda ok: max((centre[b] for b in high if ok(centre[b])), default=None)
    support = under(lambda c: c < edge) if status == "above" else under(lambda c: c <= cur) if status == "strong" or poc > cur else poc
    resistance = min((centre[b] for b in high if centre[b] > max(edge + w, cur * 1.005)), default=None)
    confidence = round(min(100, 60 * min(1, len(p) / window) + 40 * min(by[top] / by.sum() * bins / 3, 1)))
    return poc, val, vah, far, status, support, resistance, sorted(high, key=lambda b: -by[b]), [b for b in range(bins) if by[b] <= by[top] * 0.1], confidence


def profile_bars(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i, n in enumerate([200, 200, 29, 45, 120, 150]):
        close = 50 * np.exp(np.cumsum(rng.normal(0.004 if i == 4 else 0, 0.02, n)))
        if i == 1:  # a split, two for one, and one in three further back
            close[150:] /= 2
            close[120:] /= 3
        if i == 5:
            close[-40:] *= np.linspace(1, 1.3, 40)
        rows += [(i, DAY + dt.timedelta(days=k), k + 1, float(c), float(c * 1.01), float(c * 0.99), float(c), int(rng.integers(1, 50) ** 2)) for k, c in enumerate(close)]
    rows += [(9, DAY + dt.timedelta(days=k), k + 1, 5.0, 5.0, 5.0, 5.0, 10) for k in range(60)]
    return rows, spark.createDataFrame(rows, "id long, d date, t long, open double, high double, low double, close double, volume long").repartition(3)


def test_volume_profiles_stitch_splits_and_find_nodes(spark):
    from tidemark.operators import technical as T

    rows, bars = profile_bars(spark)
    chosen = (F.col("t") % 15 == 0) | (F.col("t") == 29)
    out = {(r.id, r.d): r for r in volume_profiles(bars, chosen).collect()}
    bands = {(r.id, r.d): r.band for r in T.chase_band(bars).collect()}
    x = pd.DataFrame(rows, columns="id d t open high low close volume".split())
    seen = set()
    for i, g in x.groupby("id"):
        for k in range(len(g)):
            t, d = k + 1, g.d.iloc[k]
            want = plain_profile(list(g.close[: k + 1]), list(g.volume[: k + 1]), bands[i, d]) if t % 15 == 0 or t == 29 else None
            if want is None:
                assert (i, d) not in out
                continue
            r = out[i, d]
            seen.add(r.status)
            near = lambda a, b: a is None and b is None or a == pytest.approx(b, abs=0.0051)
            assert all(near(a, b) for a, b in zip((r.poc, r.val, r.vah, r.support, r.resistance), (want[0], want[1], want[2], want[5], want[6]), strict=True)), (i, t)
            assert r.distance == pytest.approx(want[3]) and r.status == want[4] and list(r.low_nodes) == want[8] and r.confidence == want[9]
            assert sorted(r.high_nodes) == sorted(want[7])
    # after the split the profile is in the new scale: its centre is near the price
    r = out[1, DAY + dt.timedelta(days=164)]
    assert abs(r.distance) < 60 and seen >= {"above", "below", "inside"}


def test_profiles_of_nothing(spark):
    _, bars = profile_bars(spark)
    assert volume_profiles(bars.limit(0), F.lit(True)).count() == 0 and volume_profiles(bars, F.lit(None).cast("boolean")).count() == 0
    assert volume_profiles(bars.where("id = 9"), F.lit(True)).count() == 0
