"""Train and test searches over the settings of the composite."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import scores as R

from .base import R4, query, r4
from .snapshot import _ENDS, DIMS, RATED_BY, dimensions, month_ends, rate, rated_sql, setting
from .supplements import _FWD

#: Weights of fundamental, valuation, technical, momentum and whale in each profile: fixed values.
WEIGHTS = {
    "even": (0.25, 0.20, 0.20, 0.15, 0.20), "fundamental": (0.40, 0.20, 0.15, 0.10, 0.15), "valuation": (0.20, 0.35, 0.15, 0.15, 0.15), "momentum": (0.15, 0.15, 0.25, 0.30, 0.15), "whale": (0.15, 0.15, 0.15, 0.15, 0.40),
}
LEAST_SCORES, LEAST_FLOWS = (60, 65, 70), (20, 30, 40)
#: Share of the days that train, and least ratings of either side there; half as many in test.
TRAIN, SAMPLES = 0.6, 8
_FOLDS = ("train", "test")


def _gates(flow):
    return [float(flow) if name == "chip_min" else v for name, v in zip(R.GATES, R.PROFILES["balanced"], strict=True)]


def folded(rows, share=TRAIN):
    """rows with `fold`: train for the first days (that share of them, one at least), test for the rest."""
    days = F.sort_array(F.collect_set("d"))
    cut = rows.agg(F.get(days, F.greatest(F.lit(1), F.floor(F.size(days) * share).cast("int"))).alias("_cut"))  # one row; a day a month is collected
    return rows.join(F.broadcast(cut)).withColumn("fold", F.when(F.col("_cut").isNull() | (F.col("d") < F.col("_cut")), "train").otherwise("test")).drop("_cut")


def sides(rows, *by):
    """Of each setting and fold, the ratings and the mean forward return of what is bought (all but AVOID) and what is avoided, in one pass."""
    avoid = F.col("rating") == "AVOID"
    part = rows.groupBy(*by, "fold").agg(
        F.count_if(F.col("rating").isin("SUPER", "STRONG")).alias("top"), F.count_if(~avoid).alias("bought"), F.count_if(avoid).alias("avoided"), (F.avg(F.when(~avoid, F.col("fwd"))) - F.avg(F.when(avoid, F.col("fwd")))).alias("spread"),
    )
    of = lambda fold, c: F.max(F.when(F.col("fold") == fold, F.col(c)))
    return part.groupBy(*by).agg(*[of(fold, c).alias(f"{fold}_{c}") for fold in _FOLDS for c in ("top", "bought", "avoided", "spread")])


_GRID = [(name, least, flow) for name in WEIGHTS for least in LEAST_SCORES for flow in LEAST_FLOWS]
_VALUES = ", ".join(
    f"('{name}:{least}:{flow}', {', '.join(map(str, WEIGHTS[name]))}, {least}, {', '.join(map(str, _gates(flow)))})" for name, least, flow in _GRID
)
_ENOUGH = {"train": SAMPLES, "test": max(3, SAMPLES // 2)}


def _side(fold):
    of = lambda what, cond: f"{what} FILTER (fold = '{fold}' AND {cond})"
    n_bought, n_avoided = of("COUNT(*)", "rating <> 'AVOID'"), of("COUNT(*)", "rating = 'AVOID'")
    enough = f"{n_bought} >= {_ENOUGH[fold]} AND {n_avoided} >= {_ENOUGH[fold]}"
    top = of("COUNT(*)", "rating IN ('SUPER', 'STRONG')")
    bought, avoided = of("AVG(fwd)", "rating <> 'AVOID'"), of("AVG(fwd)", "rating = 'AVOID'")
    return f"{top} AS {fold}_top, CASE WHEN {enough} THEN {R4(f'{bought} - {avoided}')} END AS {fold}_spread"


@query("grid_train_test", DIMS + _FWD + f""", dq AS (SELECT dm.*, fwd FROM dm JOIN fw USING (id, d) WHERE fwd IS NOT NULL AND {_ENDS})""" + rated_sql("dq", _VALUES) + f""",
    days AS (SELECT LIST(DISTINCT d ORDER BY d) AS l FROM dq), fr AS (SELECT *, CASE WHEN COALESCE(d < l[GREATEST(1, FLOOR(LEN(l) * {TRAIN}::DOUBLE)::INT) + 1], true) THEN 'train' ELSE 'test' END AS fold FROM rated, days),
    sd AS (SELECT mode, {_side("train")}, {_side("test")} FROM fr GROUP BY mode)
    SELECT SPLIT_PART(mode, ':', 1) AS weights, SPLIT_PART(mode, ':', 2)::INT AS least, SPLIT_PART(mode, ':', 3)::INT AS flow, train_top, test_top, train_spread, test_spread, test_spread > 0 AS holds, ROW_NUMBER() OVER (ORDER BY train_spread DESC NULLS LAST, mode) AS place FROM sd""")  # fmt: skip
def grid_train_test(p):
    """Each profile of weights with each least score and least flow: its spread on the first days, its place by that, and its spread on the later days."""
    rows = folded(dimensions(p, month_ends(p)).where("fwd IS NOT NULL").select("id", "d", "fwd", *RATED_BY))
    found = sides(rate(rows, [setting(f"{name}:{least}:{flow}", WEIGHTS[name], least, _gates(flow)) for name, least, flow in _GRID]).select("mode", "fold", "rating", "fwd"), "mode")
    spread = {fold: F.when((F.col(f"{fold}_bought") >= _ENOUGH[fold]) & (F.col(f"{fold}_avoided") >= _ENOUGH[fold]), r4(F.col(f"{fold}_spread"))) for fold in _FOLDS}
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = found.select("mode", zero("train_top").alias("train_top"), zero("test_top").alias("test_top"), *[v.alias(f"{fold}_spread") for fold, v in spread.items()])
    word = lambda i: F.split("mode", ":")[i]
    # a row for each setting
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("train_spread"), "mode"))
    return found.select(word(0).alias("weights"), word(1).cast("int").alias("least"), word(2).cast("int").alias("flow"), "train_top", "test_top", "train_spread", "test_spread", (F.col("test_spread") > 0).alias("holds"), place.alias("place"))
