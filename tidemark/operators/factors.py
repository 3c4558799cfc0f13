"""Validation of cross-sectional factors against forward returns."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranks import average_rank, bucket_first, bucket_share, bucket_slice, in_tail


def rank_ic(obs: DataFrame, factor: str, fwd: str, *by: str, least: int = 4) -> DataFrame:
    """(*by, n, ic): Spearman correlation of factor and forward return within `by`; both-null rows are left out first."""
    both = obs.where(F.col(factor).isNotNull() & F.col(fwd).isNotNull())
    ranked = both.withColumns({"_a": average_rank(factor, *by), "_b": average_rank(fwd, *by)})
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), correlation("_a", "_b").alias("ic")).where(F.col("n") >= least)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation of two columns without nulls; null where one doesn't vary (F.corr fails there under ANSI)."""
    n, x, y = F.count("*").cast("double"), F.sum(a), F.sum(b)
    xy, xx, yy = F.sum(F.col(a) * F.col(b)), F.sum(F.col(a) * F.col(a)), F.sum(F.col(b) * F.col(b))
    return (n * xy - x * y) / F.nullif(F.sqrt((n * xx - x * x) * (n * yy - y * y)), F.lit(0.0))


def _met_blocks(rows: DataFrame, name: str, day: str, value: str, block: int, names: int | None, run: Callable, schema: str) -> DataFrame:
    """run(low, high, x) of every two blocks of about `block` names, with the values of both; a task holds two blocks over the calendar, however many names there are.

    A block is packed into one row and dealt out once; blocks meet as a product, which reads them again instead of
    copying them for each other. names: how many there are, about; counted if not given.
    """
    held = rows.where(F.col(value).isNotNull()).select(F.col(name).alias("name"), F.col(day).alias("day"), F.col(value).cast("double").alias("v"))
    blocks = max(1, -(-(names or held.select("name").distinct().count()) // block))

    def pack(x: pa.Table) -> pa.Table:
        x, sink = x.sort_by([("name", "ascending"), ("day", "ascending")]), io.BytesIO()
        own = x.column("own").slice(0, 1)
        with pa.ipc.new_stream(sink, x.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(x)
        return pa.table({"own": own, "data": pa.array([sink.getvalue()], pa.binary())})

    def meet(batches):
        for batch in batches:
            for low, high, a, b in zip(*[batch[c] for c in ("low", "high", "a", "b")], strict=True):
                both = [pa.ipc.open_stream(x).read_all().to_pandas() for x in ((a,) if low == high else (a, b))]
                yield run(low, high, pd.concat(both))

    packed = held.withColumn("own", F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int")).groupBy("own").applyInArrow(pack, "own int, data binary").repartition(blocks, "own")
    left, right = packed.select(F.col("own").alias("low"), F.col("data").alias("a")), packed.select(F.col("own").alias("high"), F.col("data").alias("b"))
    return left.join(right, F.col("low") <= F.col("high")).mapInPandas(meet, schema)


def _block_pairs(low: int, high: int, x: pd.DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(left names, right names, days in common, correlation) of the pairs of two blocks, from matrices of names by days."""
    names, of = np.unique(x["name"].to_numpy(), return_inverse=True)
    at = np.unique(x["day"].to_numpy(), return_inverse=True)[1]
    block_of = np.zeros(len(names), np.int64)
    block_of[of] = x["own"].to_numpy()
    v, m = np.zeros((len(names), at.max() + 1)), np.zeros((len(names), at.max() + 1))
    r = x["v"].to_numpy()
    # means drop out of a correlation; without them the sums lose no digits
    v[of, at], m[of, at] = r - (np.bincount(of, r) / np.bincount(of))[of], 1
    a, b = block_of == low, block_of == high
    n = m[a] @ m[b].T
    va, vb, ma, mb = v[a], v[b], m[a], m[b]
    sa, sb, saa, sbb = va @ mb.T, ma @ vb.T, (va * va) @ mb.T, ma @ (vb * vb).T
    with np.errstate(divide="ignore", invalid="ignore"):
        xx, yy = saa - sa * sa / n, sbb - sb * sb / n
        c = np.where((xx > 1e-12 * saa) & (yy > 1e-12 * sbb), (va @ vb.T - sa * sb / n) / np.sqrt(xx * yy), np.nan)
    i, j = np.nonzero((n >= least) & ((low != high) | (names[a][:, None] < names[b][None, :])))
    return names[a][i], names[b][j], n[i, j].astype(np.int64), c[i, j]


def pair_correlations(rows: DataFrame, name: str = "id", day: str = "d", value: str = "r", least: int = 20, block: int = 1024) -> DataFrame:
    """(a, b, n, c): Pearson correlation of each pair of names, a < b, over the `least` days or more that both have.

    Names are dealt to blocks, and every two blocks meet once. c is null where one doesn't vary.
    """
    kind = dict(rows.dtypes)[name]

    def run(low: int, high: int, x: pd.DataFrame) -> pd.DataFrame:
        left, right, n, c = _block_pairs(low, high, x, least)
        swap = left > right
        return pd.DataFrame({"a": np.where(swap, right, left), "b": np.where(swap, left, right), "n": n, "c": c})

    return _met_blocks(rows, name, day, value, block, None, run, f"a {kind}, b {kind}, n long, c double")


def correlation_sums(rows: DataFrame, name: str = "id", day: str = "d", value: str = "r", least: int = 20, block: int = 1024, names: int | None = None) -> DataFrame:
    """(name, pairs, known, total): of each name, its pairs over `least` days or more, those with a correlation, and the sum of these.

    The sums are made where two blocks meet, so that no pair leaves its task. names: how many there are, about.
    """
    kind = dict(rows.dtypes)[name]

    def run(low: int, high: int, x: pd.DataFrame) -> pd.DataFrame:
        left, right, _, c = _block_pairs(low, high, x, least)
        both = pd.DataFrame({"name": np.concatenate([left, right]), "pairs": 1, "known": np.tile(~np.isnan(c), 2).astype(np.int64), "total": np.tile(np.nan_to_num(c), 2)})
        return both.groupby("name", as_index=False).sum()

    sums = _met_blocks(rows, name, day, value, block, names, run, f"name {kind}, pairs long, known long, total double")
    return sums.groupBy(F.col("name").alias(name)).agg(F.sum("pairs").alias("pairs"), F.sum("known").alias("known"), F.sum("total").alias("total"))


def low_correlation_names(rows: DataFrame, size: int, name: str = "id", day: str = "d", value: str = "r", least: int = 20, block: int = 1024) -> DataFrame:
    """(place, name): `size` names by greedy choice, each the one of least summed correlation with those chosen before it.

    The first is the one of least mean correlation with all others. A pair without a correlation counts as 1; of equals
    the least name comes first. Each round reads the rows once against the chosen names' (size x calendar rows), and only
    the name it chooses comes to the driver.
    """
    held = rows.where(F.col(value).isNotNull()).select(F.col(name), F.col(day), F.col(value).cast("double").alias("_v")).persist()
    try:
        names = held.select(name).distinct()
        n = names.count()
        sums = names.join(correlation_sums(held, name, day, "_v", least, block, n), name, "left")
        missing = n - 1 - F.coalesce("known", F.lit(0))
        seed = sums.orderBy(F.coalesce("total", F.lit(0.0)) + missing, name).first()
        chosen = [seed[name]] if seed else []
        while len(chosen) < min(size, n):
            peers = held.where(F.col(name).isin(chosen)).select(F.col(name).alias("_peer"), day, F.col("_v").alias("_w"))
            met = held.where(~F.col(name).isin(chosen)).join(F.broadcast(peers), day).groupBy(name, "_peer")
            each = met.agg(F.when(F.count("*") >= least, correlation("_v", "_w")).alias("_c")).groupBy(name).agg(F.sum("_c").alias("_sum"), F.count("_c").alias("_n"))
            left = names.where(~F.col(name).isin(chosen)).join(each, name, "left")
            best = left.orderBy(F.coalesce("_sum", F.lit(0.0)) + len(chosen) - F.coalesce("_n", F.lit(0)), name).first()
            chosen.append(best[name])
    finally:
        held.unpersist()
    place = F.array_position(F.array(*map(F.lit, chosen)), F.col(name)).cast("int") if chosen else F.lit(None).cast("int")
    picked = rows.where(F.col(name).isin(chosen)) if chosen else rows.limit(0)
    return picked.select(name).distinct().select(place.alias("place"), name)


def ic_summary(ic: DataFrame, *by: str) -> DataFrame:
    """(*by, days, mean, sd, icir, t, positive) of daily ICs."""
    m, s, n = F.avg("ic"), F.stddev_samp("ic"), F.count("ic")
    return ic.groupBy(*by).agg(n.alias("days"), m.alias("mean"), s.alias("sd"), (m / F.nullif(s, F.lit(0.0))).alias("icir"), (m / F.nullif(s, F.lit(0.0)) * F.sqrt(n)).alias("t"), F.avg((F.col("ic") > 1e-9).cast("int")).alias("positive"))


def ordered(obs: DataFrame, factor: str, *by: str, ties: str = "id") -> DataFrame:
    """obs with a factor, with _r (rank from 1, ties by `ties`) and _n within `by`."""
    known = obs.where(F.col(factor).isNotNull())
    w = Window.partitionBy(*by)
    return known.withColumns({"_r": F.row_number().over(w.orderBy(factor, ties)), "_n": F.count("*").over(w)})


def tail_spread(obs: DataFrame, factor: str, fwd: str, *by: str, q: float = 0.2, ties: str = "id") -> DataFrame:
    """(*by, spread): mean forward return of the top floor(n q) less that of the bottom."""
    both = ordered(obs.where(F.col(fwd).isNotNull()), factor, *by, ties=ties).withColumn("_tail", in_tail(F.col("_r"), F.col("_n"), q))
    top, low = (F.avg(F.when(F.col("_tail") == x, F.col(fwd))) for x in (1, -1))
    return both.groupBy(*by).agg((top - low).alias("spread")).where("spread IS NOT NULL")


BUCKETS = {"first": bucket_first, "share": bucket_share, "slice": bucket_slice}


def bucketed(obs: DataFrame, factor: str, q: int, kind: str, *by: str, ties: str = "id") -> DataFrame:
    """obs with `bucket` by one of the bucketings."""
    return ordered(obs, factor, *by, ties=ties).withColumn("bucket", BUCKETS[kind](F.col("_r"), F.col("_n"), q)).drop("_r", "_n")


def t_stat(v: str) -> Column:
    """mean / sd sqrt(n), from three values on."""
    n, s = F.count(v), F.stddev_samp(v)
    return F.when((n >= 3) & (s > 0), F.avg(v) / s * F.sqrt(n))


def residual_ranks(obs: DataFrame, key: str, base: str, *by: str) -> DataFrame:
    """obs with `residual`: what a line on the ranks of base leaves of the ranks of key, within `by`."""
    both = obs.where(F.col(key).isNotNull() & F.col(base).isNotNull()).withColumns({"_y": average_rank(key, *by), "_x": average_rank(base, *by)})
    w = Window.partitionBy(*by)
    mx, my = F.avg("_x").over(w), F.avg("_y").over(w)
    slope = (F.avg(F.col("_x") * F.col("_y")).over(w) - mx * my) / F.nullif(F.avg(F.col("_x") * F.col("_x")).over(w) - mx * mx, F.lit(0.0))
    return both.withColumn("residual", F.col("_y") - my - slope * (F.col("_x") - mx)).drop("_x", "_y")
