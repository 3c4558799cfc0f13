"""Users' strategies: a named score over point-in-time rows, run with any number of others in one job.

    mine = Strategy("calm", -F.col("vol60"), top=20, keep=F.col("adv20") >= 2e7)
    metrics(run(rows, [mine, *others]))

Of each day's rows that a strategy keeps and can score, the `top` best are held in equal parts until the next day of
rows; days with fewer are left out. A score sees everything but the answer: the forward return's column has another name
while scores are computed, so that one that reads it fails.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import portfolio as B

_ANSWER = "_answer"


@dataclass(frozen=True)
class Strategy:
    """score: of greater values more is thought; text is read as SQL. keep: which rows may be held (all, if None)."""

    name: str
    score: Column | str
    top: int = 20
    keep: Column | str | None = None

    def __post_init__(self) -> None:
        if not self.name or self.top < 1:
            raise ValueError("a strategy has a name, and holds one row at least")


def _column(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def cohorts(rows: DataFrame, strategies: Sequence[Strategy], name: str = "id", day: str = "d", fwd: str = "fwd") -> DataFrame:
    """strategy, i (number of the strategy's day), day, name, score, fwd of what each strategy holds.

    The rows are read and scored once; every strategy's rank is a window over its own rows of one day.
    """
    if len({s.name for s in strategies}) < len(strategies) or not strategies:
        raise ValueError("strategies need names of their own, and there must be one")
    blind = rows.withColumnRenamed(fwd, _ANSWER)
    kept = lambda s: F.lit(True) if s.keep is None else F.coalesce(_column(s.keep), F.lit(False))
    of = [F.struct(F.lit(s.name).alias("strategy"), F.lit(s.top).alias("_top"), F.when(kept(s), _column(s.score).cast("double")).alias("score")) for s in strategies]
    scored = blind.select(name, day, _ANSWER, F.array(*of).alias("_of")).select(name, day, F.col(_ANSWER).alias(fwd), F.explode("_of").alias("_s")).select("_s.*", name, day, fwd).where("score IS NOT NULL AND NOT isnan(score)")
    w = Window.partitionBy("strategy", day)
    best = scored.withColumns({"_r": F.row_number().over(w.orderBy(F.desc("score"), name)), "_n": F.count("*").over(w)}).where("_n >= _top AND _r <= _top")
    # of each strategy, `top` rows a day are numbered: the calendar bounds them
    return best.select("strategy", F.dense_rank().over(Window.partitionBy("strategy").orderBy(day)).alias("i"), day, name, "score", fwd)


def run(rows: DataFrame, strategies: Sequence[Strategy], cost: float = B.COST, name: str = "id", day: str = "d", fwd: str = "fwd") -> DataFrame:
    """strategy, i, n, turnover, gross, net, equity, drawdown: each strategy's curve after costs."""
    returns = B.held_returns(cohorts(rows, strategies, name, day, fwd), "i", name, fwd, cost, ("strategy",))
    return B.curve(returns, "i", "net", "strategy")


def metrics(curves: DataFrame, per_year: float = 12.0) -> DataFrame:
    """One row a strategy: the portfolio's metrics and its mean turnover."""
    turnover = curves.groupBy("strategy").agg(F.avg("turnover").alias("turnover"))
    return B.metrics(curves, "net", per_year, "strategy").join(F.broadcast(turnover), "strategy")
