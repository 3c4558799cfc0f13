"""Sample strategies over the month-end rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.strategies import Strategy, metrics, run

from .base import R4, query, r4
from .factors import SCORED, scored

SAMPLES = [Strategy("calm", "-ABS(bias)", 5), Strategy("momentum", "mom", 5, "volume >= 20"), Strategy("mixed", "ph + pv - pm", 8)]
_OF = {"calm": ("-ABS(bias)", 5, "true"), "momentum": ("mom", 5, "volume >= 20"), "mixed": ("ph + pv - pm", 8, "true")}
_TOTAL = "EXP(SUM(LN(1 + net)))"


@query("strategies", SCORED + ", ss AS (" + " UNION ALL ".join(f"SELECT '{k}' AS strategy, {top} AS top, id, d, fwd, {s} AS score FROM scored WHERE {keep}" for k, (s, top, keep) in _OF.items()) + f"""),
    sb AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY strategy, d ORDER BY score DESC, id) AS r, COUNT(*) OVER (PARTITION BY strategy, d) AS n FROM ss WHERE score IS NOT NULL), sc_ AS (SELECT *, DENSE_RANK() OVER (PARTITION BY strategy ORDER BY d) AS i FROM sb WHERE n >= top AND r <= top),
    sh AS (SELECT a.strategy, a.i, 1 - COUNT(b.id)::DOUBLE / COUNT(*) AS turnover, AVG(a.fwd) / 100 AS gross FROM sc_ a LEFT JOIN sc_ b ON b.strategy = a.strategy AND b.i = a.i - 1 AND b.id = a.id GROUP BY ALL HAVING AVG(a.fwd) IS NOT NULL),
    sn AS (SELECT *, gross - turnover * 0.00585::DOUBLE AS net FROM sh), se AS (SELECT *, EXP(SUM(LN(1 + net)) OVER (PARTITION BY strategy ORDER BY i)) AS equity FROM sn), sd_ AS (SELECT *, equity / GREATEST(MAX(equity) OVER (PARTITION BY strategy ORDER BY i), 1) - 1 AS drawdown FROM se)
    SELECT strategy, COUNT(*) AS n, {R4(f'{_TOTAL} - 1')} AS total, {R4(f'POWER({_TOTAL}, 12.0::DOUBLE / COUNT(*)) - 1')} AS cagr, {R4('STDDEV_SAMP(net) * SQRT(12)')} AS vol, {R4(f'(POWER({_TOTAL}, 12.0::DOUBLE / COUNT(*)) - 1 - 0.01::DOUBLE) / NULLIF(STDDEV_SAMP(net) * SQRT(12), 0)')} AS sharpe, {R4('MIN(drawdown)')} AS mdd, {R4('AVG(turnover)')} AS turnover FROM sd_ GROUP BY strategy""")  # fmt: skip
def strategies(p):
    """Three strategies, ranked, held, charged and measured together."""
    m = metrics(run(scored(p), SAMPLES))
    return m.select("strategy", "n", *[r4(F.col(c)).alias(c) for c in ("total", "cagr", "vol", "sharpe", "mdd", "turnover")])
