"""Readers of outside files: universes as text or CSV, CSV with headers that vary, SQL over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watchlist(spark: SparkSession, path: str) -> DataFrame:
    """id, name, place of a text file: a line's first word is the id, its second the name; after # come remarks, doubles go."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("place"))
    words = F.split(F.trim(F.regexp_replace("line", "#", " ")), r"\s+")
    rows = lines.where("line <> '' AND NOT startswith(line, '#')").select(F.upper(words[0]).alias("id"), F.get(words, F.lit(1)).alias("name"), "place")
    return rows.groupBy("id").agg(F.min_by("name", "place").alias("name"), F.min("place").alias("place"))


def mapped_csv(spark: SparkSession, path: str, names: dict[str, list[str]], numeric: set[str] = frozenset()) -> DataFrame:
    """A CSV file in columns of fixed names: each is the first column whose header holds one of its aliases, spaces and case aside.

    Raises if a name finds no header. Numbers may have commas.
    """
    raw = spark.read.option("header", True).csv(path)
    plain = {c: c.replace(" ", "").replace("﻿", "").lower() for c in raw.columns}
    out = []
    for name, aliases in names.items():
        found = next((c for a in aliases for c, p in plain.items() if a.replace(" ", "").lower() in p), None)
        if found is None:
            raise ValueError(f"{path}: no column for {name} among {raw.columns}")
        value = F.trim(F.col(f"`{found}`"))
        out.append((F.try_to_number(F.regexp_replace(value, ",", ""), F.lit("S999999999999999D9999")).cast("double") if name in numeric else value).alias(name))
    return raw.select(*out)


def yearly(spark: SparkSession, paths: list[str], names: dict[str, list[str]], day: str, numeric: set[str]) -> DataFrame:
    """Files of one series, one a year, as one table: of days that several files have, the row of the last file stays."""
    parts = [mapped_csv(spark, x, names, numeric).withColumn("_file", F.lit(i)) for i, x in enumerate(paths)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    kept = whole.groupBy(day).agg(F.max_by(F.struct(*[c for c in whole.columns if c not in (day, "_file")]), "_file").alias("_row"))
    return kept.select(day, "_row.*").withColumn(day, F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(day, "yyyy/MM/dd"), F.try_to_date(day, "yyyyMMdd")))


def over_tables(spark: SparkSession, folder: str, tables: list[str], sql: str) -> DataFrame:
    """The rows of a SQL text over the folder's tables, each a view of its name."""
    for t in tables:
        spark.read.parquet(f"{folder}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(sql)
