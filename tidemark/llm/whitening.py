"""Embedding whitening by principal components.

Entries become whole numbers (256 x the entry, rounded down), so that sums, means and deviations are exact. The model
is fitted on every distinct vector once: its rows, centred by the exact sums, go into an MLlib RowMatrix, whose Gramian
divided by their number is the covariance; only that matrix (dimensions x dimensions) reaches the driver, where its
eigenvectors are found. All rows are then projected in tasks, which get the vectors by broadcast.

Defined cases: null vectors and vectors with null or non-finite entries are dropped; of the others, those with the most
common number of entries are used (the greater of equally common ones) and the rest dropped; entries beyond 64 bits after scaling become
the greatest or least such number; components without variance (equal vectors, or more dimensions than vectors) are
left out, so that a table of one distinct vector, or an empty one, gives no rows; a deviation beyond 64 bits is null;
repeated rows count once in the fit and each get their own result; null ids pass; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, COMPONENTS = 256, 4
_LONG = 2**63


def fixed_point(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """(ident, x): the vectors that can be used, as whole numbers."""
    good = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    kept = vectors.where(good).select(ident, F.transform(column, lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    common = kept.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return kept.where(F.size("x") == (common.size if common else 0))


@dataclass(frozen=True)
class Whitening:
    """n and sums of the fit list, trace of its covariance, and its components with their variances, greatest first."""

    n: int
    sums: list[int]
    trace: float
    vectors: np.ndarray
    values: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n times the exact difference of whole numbers x to the mean; Python's numbers where 64 bits don't hold it."""
        most = self.n * max(int(x.max()), -int(x.min()), 0) + max(map(abs, self.sums)) if x.size else 0
        kind = np.int64 if most < _LONG else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(float) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of the squares of n x - sums, by row."""
        y = self.centred(x)
        near = (y.astype(float) ** 2).sum(1)
        out = np.full(len(x), None, object)
        small = near < 2.0**62
        out[small] = (y[small] ** 2).sum(1)
        for i in np.flatnonzero(~small & (near < 2.0**64)):
            exact = sum(int(v) ** 2 for v in y[i])
            out[i] = exact if exact < _LONG else None
        return out.tolist()


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """Each vector x of rows once."""
    return written(rows.select("x").distinct(), "distinct-vectors")


def fit(distinct: DataFrame, components: int | None = COMPONENTS) -> Whitening | None:
    """The whitening of a table of distinct vectors x; None where they have no variance. All components if None."""
    n = distinct.count()
    exact = F.col("v").cast("decimal(20,0)")
    sums = [int(r.s) for r in distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(exact).alias("s")).orderBy("i").collect()]
    if not n or not sums:
        return None
    # n x - sum is exact, in 64 bits where they hold it; it is rounded once, by the division
    wide = n * max(distinct.agg(F.max(F.greatest(F.array_max("x").cast("double"), -F.array_min("x").cast("double")))).first()[0], 0.0) + max(map(abs, sums)) >= _LONG / 2
    kind = "decimal(38,0)" if wide else "long"
    totals = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    centred = F.zip_with("x", totals, lambda v, s: (v.cast(kind) * F.lit(str(n)).cast("decimal(18,0)" if wide else kind) - s).cast("double") / n)
    rows = MLUtils.convertVectorColumnsFromML(distinct.select(array_to_vector(centred).alias("row")), "row")
    covariance = RowMatrix(rows, n, len(sums)).computeGramianMatrix().toArray() / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > max(values[0], 0.0) * len(sums) * np.finfo(float).eps).sum())
    keep = rank if components is None else min(components, rank)
    return Whitening(n, sums, float(np.trace(covariance)), vectors[:, :keep].copy(), values[:keep].copy()) if keep else None


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.int64)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """The rows' first column, their deviation and the whitened vector of each (ident, x)."""
    ident = rows.schema[0]
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = matrix(b["x"])
                yield pd.DataFrame({ident.name: b[ident.name], "deviation": pd.array(sent.value.deviations(x), "Int64"), "whitened": list(sent.value.project(x))})

    return rows.mapInPandas(project, f"`{ident.name}` {ident.dataType.simpleString()}, deviation long, whitened array<double>")


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    sent = distinct.sparkSession.sparkContext.broadcast(model)
    k = len(model.values)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            if len(b):
                w = np.column_stack([sent.value.project(matrix(b["x"])), np.ones(len(b))])
                total += w.T @ w
        i, j = np.divmod(np.arange((k + 1) ** 2), k + 1)
        yield pd.DataFrame({"i": i, "j": j, "s": total.ravel()})

    sums = np.zeros((k + 1, k + 1))
    for r in distinct.mapInPandas(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        sums[r.i, r.j] = r.s
    mean = sums[:k, k] / model.n  # zero but for rounding
    return float(np.abs(sums[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def components_of(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """ident, component, n, deviation, whitened, explained, identity_error of each usable row and component."""
    rows = written(fixed_point(vectors, ident, column), "fixed-point")
    distinct = distinct_vectors(rows)
    model = fit(distinct, components)
    shape = rows.select(ident).limit(0) if model is None else whitened(rows, model)
    if model is None:
        return shape.selectExpr(f"`{ident}`", "1 AS component", "1L AS n", "1L AS deviation", "1D AS whitened", "1D AS explained", "1D AS identity_error")
    error = identity_error(distinct, model)
    shares = F.array(*[F.lit(float(v)) for v in model.values / model.trace])
    each = shape.select(ident, "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(ident, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", F.col("value").alias("whitened"), F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark, sf_dir):
    return components_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
