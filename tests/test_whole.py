"""Queries over whole tables against brute force."""

import datetime as dt
import json
import math
from bisect import bisect_right
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import factors as X
from tidemark.plans import factors, portfolios, relational, supplements, technicals

DAY = dt.date(1995, 1, 1)


def series(spark, n_ids, n_days, keep=0.8, seed=5):
    """(panels, frame of id, d, t, open, close, volume) of walks with gaps."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(1, n_ids + 1):
        days = [k for k in range(n_days) if rng.random() < keep]
        close = [float(c) for c in 100 * np.exp(np.cumsum(rng.normal(0, 0.02, len(days))))]
        rows += [(i, DAY + dt.timedelta(days=k), t + 1, close[max(t - 1, 0)], c, 100 + t) for t, (k, c) in enumerate(zip(days, close, strict=True))]
    names = "id d t open close volume".split()
    return SimpleNamespace(sbars=spark.createDataFrame(rows, "id long, d date, t long, open double, close double, volume long")), pd.DataFrame(rows, columns=names)


def test_pair_correlations_meet_all_entities(spark):
    p, x = series(spark, 17, 60)
    x["r"] = x.groupby("id").close.pct_change()
    wide = x.pivot(index="d", columns="id", values="r")
    want = {(a, b): wide[[a, b]].dropna() for a in wide for b in wide if a < b}
    want = {k: (len(v), v.corr().iloc[0, 1]) for k, v in want.items() if len(v) >= 20}
    rows = spark.createDataFrame([(int(i), d, None if math.isnan(r) else r) for i, d, r in zip(x.id, x.d, x.r, strict=True)], "id long, d date, r double")
    for block in (4, 256):
        got = X.pair_correlations(rows, block=block).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.n for r in got} == {k: n for k, (n, _) in want.items()}
        assert {(r.a, r.b): r.c for r in got} == pytest.approx({k: c for k, (_, c) in want.items()})
    out = factors.avg_pair_corr(p).first()
    assert out.pairs == len(want) > 66 and out["mean"] == pytest.approx(np.mean([c for _, c in want.values()]), abs=1e-4)


def test_pair_correlations_of_constants_are_null(spark):
    rows = spark.createDataFrame([(i, DAY + dt.timedelta(days=k), 0.5 if i == 1 else float(k % 3)) for i in (1, 2, 3) for k in range(30)], "id long, d date, r double")
    assert {(r.a, r.b): r.c for r in X.pair_correlations(rows).collect()} == {(1, 2): None, (1, 3): None, (2, 3): pytest.approx(1)}


def test_asof_regime_is_the_index_for_all_entities(spark):
    p, x = series(spark, 8, 330)
    x["r"] = x.groupby("id").close.pct_change()
    day = x[x.r.abs() < 0.5].groupby("d").r.mean().sort_index()
    level = (1 + day).cumprod()
    mean = level.rolling(200).mean().dropna()
    raw = list(level[mean.index] > mean)
    states, run = [], 0
    for i, now in enumerate(raw):
        run = run + 1 if i and now == raw[i - 1] else 1
        states.append(now if run >= 3 else states[-1] if states else raw[0])
    known = list(mean.index)
    at = lambda d: bool(bisect_right(known, d) and states[bisect_right(known, d) - 1])
    got = sorted((r.id, r.d, r.up) for r in portfolios.asof_regime(p).collect())
    assert got == sorted((i, d, at(d)) for i, d in zip(x.id, x.d, strict=True)) and len({u for *_, u in got}) == 2


def raw_bars(spark):
    rng = np.random.default_rng(11)
    rows = [(i, DAY + dt.timedelta(days=k), int(rng.integers(1, 200)) * 100, int(rng.integers(1, 9))) for i in (1, 2) for k in range(700) if rng.random() < 0.3]
    return SimpleNamespace(bars=spark.createDataFrame(rows, "id long, d date, cents long, volume long")), rows


def test_yoy_nearest_takes_all_bars(spark):
    p, rows = raw_bars(spark)

    def earlier(i, d):
        near = [(abs((d - e).days - 365), e, c) for j, e, c, _ in rows if i == j and abs((d - e).days - 365) <= 60]
        return min(near)[2] if near else None

    got = sorted((r.id, r.d, r.cents, r.earlier) for r in relational.yoy_nearest(p).collect())
    assert got == sorted((i, d, c, earlier(i, d)) for i, d, c, _ in rows)


def test_split_adjust_takes_later_splits(spark):
    p, rows = raw_bars(spark)
    want = {}
    for i in (1, 2):
        log, after = 0.0, None
        for _, d, c, v in sorted((r for r in rows if r[0] == i), reverse=True):
            if after is not None and after / (c / v / 100) < 0.5:
                log += math.log(max(round(c / v / 100 / after), 1))
            want[i, d], after = round(log, 4), c / v / 100
    assert {(r.id, r.d): r.split_log for r in technicals.split_adjust(p).collect()} == pytest.approx(want, abs=1e-4)


def test_exposure_json_has_all_days(spark):
    p, x = series(spark, 6, 30)
    got = {r.d: json.loads(r.snapshot) for r in relational.exposure_json(p).collect()}
    assert got == {d: {"n": len(g), "ids": sorted(g.id)} for d, g in x.groupby("d")}


def expected_exits(entries, x):
    out = []
    bars = {i: list(zip(g.t, g.open, g.close, strict=True)) for i, g in x.sort_values("t").groupby("id")}
    for e in entries:
        peak, done = e.close0, None
        path = bars[e.id][e.t0 : e.t0 + 20]
        for t, _, c in path:
            peak = max(peak, c)
            reason = "support" if c < e.support else "trailing" if c < peak * (1 - e.buffer / 100) else None
            if reason:
                after = bars[e.id][t : t + 1]
                done = (e.id, e.t0, t, reason, (after[0][1] if after else c) / e.close0 - 1)
                break
        if path:
            out.append(done or (e.id, e.t0, path[-1][0], "time", path[-1][2] / e.close0 - 1))
    return out


def test_exits_start_at_every_bar(spark):
    p, x = series(spark, 3, 150)
    p.sbars = p.sbars.selectExpr("*", "greatest(open, close) * 1.01 AS high", "least(open, close) * 0.99 AS low")
    starts = portfolios.entries(p).collect()
    known = x.groupby("id").close.transform(lambda c: c.pct_change().rolling(60, min_periods=20).std()).notna()
    assert {(e.id, e.t0) for e in starts} == set(zip(x.id[known], x.t[known], strict=True))
    want = {(i, a, b, why): r for i, a, b, why, r in expected_exits(starts, x)}
    got = {(r.id, r.t0, r.t, r.reason): r.ret for r in portfolios.exit_trailing(p).collect()}
    assert got == pytest.approx(want, abs=1e-4) and {k[3] for k in got} == {"support", "trailing", "time"}
    full = supplements.exit_full(p).collect()
    assert {(r.id, r.t0) for r in full} == {k[:2] for k in want}


def test_fills_are_sold_ten_bars_later(spark):
    p, x = series(spark, 3, 60)
    fee = lambda v: max(v * 0.0006, 1.0)
    want = {}
    for i, g in x.sort_values("t").groupby("id"):
        for d, c, v, s in zip(g.d, g.close, g.volume, g.close.shift(-10), strict=True):
            if not math.isnan(s):
                want[i, d] = (s - c) * v - fee(c * v) - fee(s * v) - s * v * 0.003
    assert {(r.id, r.d): r.pnl for r in portfolios.fills_pnl(p).collect()} == pytest.approx(want, abs=0.01)
