"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of the budget; sources above `max_epochs` times their size are
clamped there and the excess is shared again by weight among the others until none is above. A source is then
repeated target / size times: the whole part for every document, the fraction for the documents that come
first in a seeded order of the source until their sizes add up to it (so a source misses its target by less
than one document).

Defined cases: a null text has size 0 and is taken like any other; a null source is a source of its own,
sorted last; repeated rows are separate documents, told apart by an ordinal that breaks ties in the seeded
order (which of two equal rows is taken is arbitrary, the multiset of rows isn't); an empty table gives no
rows; extra columns pass through `mixed_documents`, whatever their names; a text of any length is only counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_small, n_words, own_columns, written

#: Hash ranges into which a source is dealt for its running sum; a source of any size has so many tasks.
RANGES = 4096


def water_fill(sources: DataFrame, budget: Column | None = None, max_epochs: float = 3.0) -> DataFrame:
    """Adds `target` to (source, weight, source_size), one row per source.

    Each round clamps what is above its cap; only two sums a round come to the driver.
    """
    cap = F.col("source_size").cast("double") * max_epochs
    total = sources.agg(F.coalesce((budget if budget is not None else F.sum("source_size")).cast("double"), F.lit(0.0))).first()[0]
    level, clamped = 0.0, -1
    while True:
        at = F.col("weight") * F.lit(level) >= cap
        held, free, n = sources.agg(
            F.coalesce(F.sum(F.when(at, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~at, F.col("weight").cast("double"))), F.lit(0.0)),
            F.count(F.when(at, 1)),
        ).first()
        if n == clamped or free == 0:
            break
        level, clamped = (total - held) / free, n
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


def cycled_weights(source: str = "source", weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weights dealt in turn to the sources by code point, null last; the input has one row per source."""
    i = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    return F.element_at(F.array(*map(F.lit, weights)), (i % len(weights) + 1).cast("int"))


def thin(docs: DataFrame, seed: int = 42) -> DataFrame:
    """doc_id, source, size, at (the seeded hash) and row of every row of docs (doc_id, text, source)."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("at"), F.monotonically_increasing_id().alias("row"))


def _range(at: Column) -> Column:
    """The hash range of a row; the seeded order is by range, then by the hash itself."""
    return F.pmod(F.shiftrightunsigned(at, 40), F.lit(RANGES)).cast("int")


def decided(rows: DataFrame, weight: Column | None = None, max_epochs: float = 3.0) -> DataFrame:
    """rows (see `thin`, written) with source_size, target, whole (repetitions of every row) and extra (1 for the rows that get one more)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = written(sums.withColumn("weight", weight if weight is not None else cycled_weights()), "mix-sources")
    targets = water_fill(weighted, max_epochs=max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select(
        F.col("source").alias("of"), "source_size", "target", F.floor(rate + 1e-12).cast("long").alias("whole"), ((rate - F.floor(rate + 1e-12)) * F.col("source_size")).alias("rest")
    )
    # the running sum in the seeded order: over the ranges first, then within each
    rows = rows.withColumn("range", _range(F.col("at")))
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("n"))
    before = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), "n", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    both = written(before.join(targets, before["s"].eqNullSafe(F.col("of"))), "mix-ranges")
    # ranges below `low` are wholly taken and those above `high` wholly left; only what is between needs an order
    low, high = F.min(F.when(F.col("before") + F.col("n") >= F.col("rest"), F.col("r"))), F.max(F.when(F.col("before") <= F.col("rest"), F.col("r")))
    edges = broadcast_small(written(both.groupBy("of", "source_size", "target", "whole", "rest").agg(low.alias("low"), high.alias("high")), "mix-edges"))
    placed = rows.join(edges, rows["source"].eqNullSafe(F.col("of")))
    keep = [*rows.columns, "source_size", "target", "whole"]
    between = F.coalesce(F.col("range").between(F.col("low"), F.col("high")), F.lit(False))
    clear = placed.where(~between).select(*keep, F.when(F.col("low").isNull() | (F.col("range") < F.col("low")), 1).otherwise(0).alias("extra"))
    first = both.join(edges.select(F.col("of").alias("o"), "low", "high"), both["s"].eqNullSafe(F.col("o")) & both["r"].between(F.col("low"), F.col("high"))).select(F.col("s").alias("s2"), F.col("r").alias("r2"), "before")
    cut = placed.where(between).join(broadcast_small(first), rows["source"].eqNullSafe(F.col("s2")) & (F.col("range") == F.col("r2")))
    within = F.sum("size").over(Window.partitionBy("source", "range").orderBy("at", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("reached", F.col("before") + within)
    cut = cut.select(*keep, F.when(F.col("reached") - F.col("size") / 2 <= F.col("rest"), 1).otherwise(0).alias("extra"))
    return clear.unionByName(cut).drop("range")


def mix(docs: DataFrame, weight: Column | None = None, max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, at (the seeded hash) for every row of docs (doc_id, text, source)."""
    rows = decided(written(thin(docs, seed), "mix"), weight, max_epochs)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("extra")).alias("repeats"), "at")


def op6_mixing(spark, sf_dir):
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats")


def mixed_documents(docs: DataFrame, weight: Column | None = None, max_epochs: float = 3.0, seed: int = 42) -> DataFrame:
    """The mix itself: docs with every row repeated as often as the mix takes it, in the columns of docs.

    Rows are decided on without their texts; what differs within a source, the rows that get one repetition more, comes
    before one place of the seeded order. So each source's place and whole repetitions are joined to the texts, which
    are not shuffled.
    """
    own = docs.select(F.struct(*own_columns(docs)).alias("doc"), F.monotonically_increasing_id().alias("row"))
    own = written(own, "mix-docs")
    order = F.struct(_range(F.col("at")).alias("range"), "at", "doc_id", "size", "row")
    facts = [F.col("doc.doc_id").alias("doc_id"), F.col("doc.source").alias("source"), n_words(F.col("doc.text")).alias("size"), F.xxhash64(F.lit(seed), "doc.doc_id", "doc.text").alias("at"), F.col("row")]
    rows = own.select(*facts)
    last = decided(written(rows, "mix"), weight, max_epochs).groupBy("source", "whole").agg(F.max(F.when(F.col("extra") == 1, order)).alias("last"))
    last = broadcast_small(written(last.withColumnRenamed("source", "of"), "mix-last"))
    joined = own.select("doc", *facts).join(last, F.col("source").eqNullSafe(F.col("of")))
    times = F.col("whole") + F.when(F.col("last").isNotNull() & (order <= F.col("last")), 1).otherwise(0)
    return joined.withColumn("times", times.cast("int")).where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("doc.*")
