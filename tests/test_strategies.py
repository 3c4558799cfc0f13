"""Users' strategies: together as alone, blind to the answer, by the definition."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.operators.portfolio import COST
from tidemark.strategies import Strategy, cohorts, metrics, run


def rows(spark, n=12, days=9):
    rng = random.Random(4)
    data = [(i, d, rng.choice([None, float(rng.randrange(6))]), rng.random(), rng.gauss(1, 5)) for i in range(n) for d in range(days)]
    return data, spark.createDataFrame(data, "id long, d int, a double, b double, fwd double").repartition(3)


STRATEGIES = [Strategy("high", "a", 3), Strategy("low", "-b", 4, "a >= 1"), Strategy("both", "a + 3 * b", 2, "d <> 4")]


def test_strategies_together_are_each_alone(spark):
    _, df = rows(spark)
    key = lambda r: (r.strategy, r.i)
    together = sorted((r for r in run(df, STRATEGIES).collect()), key=key)
    alone = sorted((r for s in STRATEGIES for r in run(df, [s]).collect()), key=key)
    assert together == alone and {r.strategy for r in together} == {"high", "low", "both"}
    m = {r.strategy: r for r in metrics(run(df, STRATEGIES)).collect()}
    for s in STRATEGIES:
        one = metrics(run(df, [s])).first()
        assert one == m[s.name]


def test_a_strategy_is_its_definition(spark):
    data, df = rows(spark)
    got = {(r.i, r.id) for r in cohorts(df, STRATEGIES).where("strategy = 'low'").collect()}
    want, held, equity, i = set(), set(), 1.0, 0
    curve = {}
    for d in range(9):
        able = sorted((-(-b), k, fwd) for k, day, a, b, fwd in data if day == d and a is not None and a >= 1)
        if len(able) < 4:
            continue
        i += 1
        now = {k for _, k, _ in able[:4]}
        want |= {(i, k) for k in now}
        equity *= 1 + sum(f for *_, f in able[:4]) / 400 - COST * (1 - len(now & held) / 4)
        curve[i], held = equity, now
    assert got == want
    assert {r.i: r.equity for r in run(df, STRATEGIES).where("strategy = 'low'").collect()} == pytest.approx(curve)


def test_a_score_cannot_see_the_answer(spark):
    _, df = rows(spark)
    assert cohorts(df, [Strategy("low", -F.col("b"), 4, F.col("a") >= 1)]).collect()
    for cheat in ("fwd", F.col("fwd") + F.col("b")):
        with pytest.raises(AnalysisException):
            cohorts(df, [Strategy("cheat", cheat)])
    with pytest.raises(ValueError):
        cohorts(df, [STRATEGIES[0], STRATEGIES[0]])
    with pytest.raises(ValueError):
        Strategy("none", "a", 0)
    assert run(df.limit(0), STRATEGIES).count() == 0
