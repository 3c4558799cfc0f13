"""A store of scores: one table by mode, month and version of the weights, with pruned reads.

A version is a hash of everything that decides a score besides the data. Building scores again replaces the partitions
(mode, month, version) that the new rows have, and no others, so that a rebuild of one month or of one version leaves
the rest alone. Readers filter the partition columns first, so that a day or a version is read without the others.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARTITIONS = ("mode", "month", "version")
SCHEMA = (
    "id long, d date, composite double, rating string, fundamental double, valuation double, technical double, momentum double, whale double, confidence double, built timestamp, mode string, month string, version string"
)
DIMENSIONS = ("composite", "fundamental", "valuation", "technical", "momentum", "whale")


def weights_version(settings: Mapping) -> str:
    """Ten hex digits that tell one set of settings (weights, gates, switches) from any other, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:10]


def month_of(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


class ScoreStore:
    """Scores under a path; an absent table reads as an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def table(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def write(self, scores: DataFrame, versions: Mapping[str, str]) -> None:
        """Replaces the partitions that scores (id, d, mode, composite, rating, the dimensions, confidence) have; versions: of each mode.

        Rows of one id, day and mode count once (the highest composite, so that a retry writes the same).
        """
        if unknown := [r["mode"] for r in scores.select("mode").distinct().collect() if r["mode"] not in versions]:
            raise ValueError(f"no version of the modes {sorted(map(str, unknown))}")
        version = F.create_map(*[F.lit(x) for pair in versions.items() for x in pair])[F.col("mode")]
        rows = scores.withColumns({"month": month_of(F.col("d")), "version": version, "built": F.current_timestamp()})
        known = [f.name for f in self.spark.createDataFrame([], SCHEMA).schema]
        order = Window.partitionBy("id", "d", "mode").orderBy(F.desc("composite"))
        rows = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in known]).withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
        # rows of a partition come together, in as many files as their size asks for
        rows.hint("rebalance", *map(F.col, PARTITIONS)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(self.path)

    def of(self, mode: str) -> DataFrame:
        return self.table.where(F.col("mode") == mode)

    def as_of_dates(self, mode: str) -> DataFrame:
        """d: every day that has scores."""
        return self.of(mode).select("d").distinct().orderBy("d")

    def ids(self, mode: str | None = None) -> DataFrame:
        return (self.table if mode is None else self.of(mode)).select("id").distinct()

    def newest(self, mode: str) -> DataFrame:
        """Each id's newest row: the last day's, of the version built last."""
        row = F.struct(*[c for c in self.table.columns if c != "id"])
        return self.of(mode).groupBy("id").agg(F.max_by(row, F.struct("d", "built", "version")).alias("_x")).select("id", "_x.*")

    def latest_scores(self, mode: str) -> DataFrame:
        return self.newest(mode).orderBy(F.desc("composite"), "id")

    def universe(self, mode: str) -> DataFrame:
        """n, d, version: how many ids have scores, the newest day and its version."""
        return self.newest(mode).agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max_by("version", F.struct("d", "built")).alias("version"))

    def screen(self, mode: str, day: str | None = None, least: float | None = None, ratings: Sequence[str] | None = None, confidence: float | None = None, top: int = 30) -> DataFrame:
        """The best rows of a day (None: each id's newest) with `pct_rank`, their place among all of that day, in percent.

        Of a day's several versions the one built last counts. The rank is over the ids of one day.
        """
        if day is None:
            rows = self.newest(mode)
        else:
            at = F.to_date(F.lit(day))
            rows = self.of(mode).where((F.col("month") == day[:7]) & (F.col("d") == at))
            rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("built"), F.desc("version")))).where("_r = 1").drop("_r")
        rows = rows.withColumn("pct_rank", F.round(F.percent_rank().over(Window.orderBy("composite")) * 100, 1))
        if least is not None:
            rows = rows.where(F.col("composite") >= least)
        if ratings is not None:
            rows = rows.where(F.col("rating").isin(list(ratings)))
        if confidence is not None:
            rows = rows.where(F.col("confidence") >= confidence)
        return rows.orderBy(F.desc("composite"), "id").limit(top)

    def score_history(self, entity: int, mode: str, days: int = 10, same_version: bool = True) -> DataFrame:
        """d, the scores and version of an id's last days, oldest first; of the newest row's version only, unless asked for all."""
        rows = self.of(mode).where(F.col("id") == entity)
        if same_version:
            last = rows.orderBy(F.desc("d"), F.desc("built"), F.desc("version")).select("version").first()
            rows = rows.where(F.col("version") == (last.version if last else ""))  # prunes to that version's partitions
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("built"), F.desc("version")))).where("_r = 1")
        return rows.select("d", *DIMENSIONS, "version").orderBy(F.desc("d")).limit(days).orderBy("d")
