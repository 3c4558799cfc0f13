"""Tables of dated snapshots: reads, upserts and merges by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scan_union(spark: SparkSession, *paths: str) -> DataFrame:
    """All Parquet folders as one table by column name; columns that a file lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(*paths)


def scan_entity(table: DataFrame, key: str, value) -> DataFrame:
    """The rows of one entity; the filter reaches the scan."""
    return table.where(F.col(key) == value)


def upsert_first_seen(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and those rows of new whose keys it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def keep_one(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def upsert_keep_last(old: DataFrame, new: DataFrame, keys: list[str], at: str) -> DataFrame:
    """old and new with the latest row of each key; of equal times, that of new."""
    both = old.withColumn("_src", F.lit(0)).unionByName(new.withColumn("_src", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, keys, F.col(at).desc_nulls_last(), F.col("_src").desc()).drop("_src")


def merge_by_priority(keys: list[str], *sources: DataFrame) -> DataFrame:
    """All sources, of each key the row of the first source that has it."""
    ranked = [s.withColumn("_src", F.lit(i)) for i, s in enumerate(sources)]
    both = ranked[0]
    for s in ranked[1:]:
        both = both.unionByName(s, allowMissingColumns=True)
    return keep_one(both, keys, F.col("_src")).drop("_src")


def seed_and_delta(seed: DataFrame, snapshots: DataFrame, day: str) -> DataFrame:
    """seed and the snapshots of later days than its last."""
    last = seed.agg(F.max(day).alias("_last"))
    later = snapshots.join(F.broadcast(last), snapshots[day] > F.col("_last")).drop("_last")
    return seed.unionByName(later, allowMissingColumns=True)


def since_watermark(old: DataFrame, feed: DataFrame, keys: list[str], day: str) -> DataFrame:
    """old, and the feed from old's last day on, which replaces old's rows of the same keys."""
    last = old.agg(F.max(day).alias("_last"))
    fresh = feed.join(F.broadcast(last), feed[day] >= F.col("_last")).drop("_last")
    return merge_by_priority(keys, fresh, old)


def freeze(cohort: DataFrame, path: str, day: str, force: bool = False) -> None:
    """Writes the cohort of a day once; a later call leaves it alone unless forced."""
    cohort.write.mode("overwrite" if force else "ignore").parquet(f"{path}/cohort_date={day}")


def positional(rows: DataFrame, names: dict[int, str], numeric: set[str], thousands: set[str], id_column: str, day_column: str, width: int) -> DataFrame:
    """A sheet's string columns by position as a typed table: '1101 name' split in id and name, comma numbers, thousands, days.

    Raises if the sheet hasn't the expected number of columns.
    """
    if len(rows.columns) != width:
        raise ValueError(f"{len(rows.columns)} columns; expected {width}")
    number = lambda c: F.expr(f"try_cast(replace(`{c}`, ',', '') AS DOUBLE)")
    out = []
    for i, name in names.items():
        c = rows.columns[i]
        if name == id_column:
            parts = F.split(F.trim(F.col(c)), r"\s+", 2)
            out += [parts[0].alias(name), F.get(parts, F.lit(1)).alias(f"{name}_name")]
        elif name == day_column:
            out.append(F.coalesce(F.try_to_date(c, "yyyyMMdd"), F.try_to_date(c, "yyyy-MM-dd"), F.try_to_date(c, "yyyy/MM/dd")).alias(name))
        elif name in numeric:
            out.append((number(c) * (1000 if name in thousands else 1)).alias(name))
        else:
            out.append(F.col(c).alias(name))
    return rows.select(*out).where(F.col(id_column).isNotNull() & F.col(day_column).isNotNull())


def checked(rows: DataFrame, least: int, what: str) -> DataFrame:
    """rows; reading them fails if they are fewer than the floor of their source."""
    n = rows.agg(F.count("*").alias("_n"))
    guard = n.select(F.assert_true(F.col("_n") >= least, f"{what}: too few rows").alias("_ok"))
    return rows.join(F.broadcast(guard), F.expr("_ok IS NULL")).drop("_ok")


def melted(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Long form: keys, type, value; nulls are left out."""
    return rows.unpivot(keys, values, "type", "value").where("value IS NOT NULL")
