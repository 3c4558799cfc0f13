"""Exponential means of long series against the recursion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import technical
from tidemark.operators.windows import Series


def recursion(values, span):
    a, out = 2 / (span + 1), []
    for x in values:
        out.append(x if not out else (1 - a) * out[-1] + a * x)
    return out


def long_series(kind, n):
    rng = random.Random(n)
    return [10.0] * n if kind == "constant" else [100 * math.exp(rng.gauss(0, 1)) for _ in range(n)]


@pytest.mark.parametrize("kind", ["constant", "random"])
@pytest.mark.parametrize("block", [None, 256, 7])
def test_smoothed_is_the_recursion_at_any_length(spark, kind, block):
    series = {1: long_series(kind, 8000), 2: long_series(kind, 3), 3: long_series(kind, 1), 4: long_series(kind, 257)}
    rows = spark.createDataFrame([(i, t, v) for i, values in series.items() for t, v in enumerate(values)], "id int, d int, v double").repartition(4)
    spans = {f"e{k}": ("v", k) for k in (1, 2, 5, 9, 12, 20, 26)} if block is None else {f"e{k}": ("v", k) for k in (5, 9, 26)}
    out = Series().smoothed(rows, F.col("d"), block, **spans)
    assert out.columns == ["id", "d", "v", *spans] or sorted(out.columns) == sorted(["id", "d", "v", *spans])
    got = {}
    for r in out.collect():
        got.setdefault(r.id, {})[r.d] = r
    for i, values in series.items():
        for name, (_, span) in spans.items():
            for t, want in enumerate(recursion(values, span)):
                assert got[i][t][name] == pytest.approx(want, rel=1e-9)


def test_spans_far_apart_share_a_call(spark):
    values = long_series("random", 5000)
    rows = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "id int, d int, v double")
    last = {r.d: r for r in Series().smoothed(rows, F.col("d"), quick=("v", 2), slow=("v", 500)).collect()}
    for name, span in (("quick", 2), ("slow", 500)):
        want = recursion(values, span)
        assert all(last[t][name] == pytest.approx(want[t], rel=1e-9) for t in range(0, 5000, 37))


def test_macd_of_five_thousand_bars(spark):
    close = long_series("random", 5200)
    rows = [(1, t, t + 1, c) for t, c in enumerate(close)]
    bars = spark.createDataFrame(rows, "id int, d int, t int, close double")
    fast, slow = recursion(close, 12), recursion(close, 26)
    macd = [a - b for a, b in zip(fast, slow, strict=True)]
    signal = recursion(macd, 9)
    for r in technical.macd(bars).collect():
        assert r.macd == pytest.approx(macd[r.d], abs=1e-8) and r.signal == pytest.approx(signal[r.d], abs=1e-8)
        if r.d:
            up = macd[r.d - 1] <= signal[r.d - 1] and macd[r.d] > signal[r.d]
            assert (r.cross == "golden") == up
