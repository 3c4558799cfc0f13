"""Sharding by extendible hashing.

A document's address is its 64-bit content hash. The directory is indexed by a prefix of the address; a bucket
whose bytes exceed the limit is split on the next bit, and only that one, until every shard fits. Addresses of
equal rows are told apart by a second word of bits (a row ordinal, hashed), so that a key that holds a third of
all rows splits like any other. A single document above the limit has a shard of its own.

`write_shards` deals the rows out by shard and writes each as Parquet, in a folder of its own.

Defined cases: a null text has 0 bytes; null ids hash like a value; equal rows are spread by ordinal; an empty
table gives no rows; extra columns are not read by `shard` and are written with the rest by `write_shards`, whatever
their names; a text above the limit, however long, is a shard of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import broadcast_small, new_path, own_columns, own_name, written

SHARD_BYTES = 8 << 20
#: Bits of the directory below the expected depth; a bucket that needs still more gets a directory of its own.
SPARE_BITS = 4
WORD_BITS = 64


def _bits(depth) -> F.Column:
    """The first `depth` bits of the address as text."""
    return F.substring(F.col("address"), 1, depth) if isinstance(depth, int) else F.expr(f"substring(address, 1, {depth})")


def directory(thin: DataFrame, limit: int, base: int, depth: int) -> DataFrame:
    """(fine, shard, shard_bytes, shard_docs, fits): the bucket of each address prefix of base + depth bits.

    thin: address (text of bits), bytes. All prefixes between are summed in one aggregation, of which the
    shallowest that fits (or holds one document) is the bucket.
    """
    fine = thin.groupBy(_bits(base + depth).alias("fine")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("docs"))
    levels = fine.withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(base + depth))))
    nodes = levels.groupBy(F.expr("substring(fine, 1, d)").alias("shard"), "d").agg(F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs"))
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_docs") == 1)
    found = levels.select("fine", F.expr("substring(fine, 1, d)").alias("shard"), "d").join(nodes.withColumn("fits", fits), ["shard", "d"]).where(F.col("fits") | (F.col("d") == base + depth))
    best = found.groupBy("fine").agg(F.min_by(F.struct("shard", "shard_bytes", "shard_docs", "fits"), "d").alias("b"))
    return best.select("fine", "b.*")


def thin(docs: DataFrame, row: F.Column | None = None, *more: str) -> DataFrame:
    """doc_id, bytes, address and row (an ordinal) of every row of docs (doc_id, text), and more columns if asked for."""
    row = row if row is not None else F.monotonically_increasing_id()
    both = F.concat(*[F.lpad(F.bin(h), WORD_BITS, "0") for h in (F.xxhash64("doc_id", "text"), F.xxhash64(F.lit(1), row))])
    return docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), both.alias("address"), row.alias("row"), *more)


def shard(docs: DataFrame, limit: int = SHARD_BYTES, depth: int | None = None) -> DataFrame:
    """doc_id, bytes, shard (the bucket's prefix of bits), depth, shard_bytes, shard_docs, row, one row per row of docs."""
    return assigned(written(thin(docs), "shard"), limit, depth).select("doc_id", "bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_docs", "row")


def assigned(left: DataFrame, limit: int = SHARD_BYTES, depth: int | None = None) -> DataFrame:
    """left (bytes and address, see `thin`, and any other columns; cheap to read again) with shard, shard_bytes and shard_docs."""
    columns = left.columns
    total = left.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    depth = depth if depth is not None else min(24, max(1, math.ceil(math.log2(max(total, 1) / limit + 1)) + SPARE_BITS))
    out, base = [], 0
    while True:
        here = directory(left, limit, base, min(depth, 2 * WORD_BITS - base))
        here = written(here, "shard-directory")
        placed = left.withColumn("fine", _bits(base + depth)).join(broadcast_small(here), "fine")
        done = F.col("fits") | F.lit(base + depth >= 2 * WORD_BITS)
        out.append(placed.where(done))
        over = here.where(~F.col("fits")).limit(1).count()
        base += depth
        if not over or base >= 2 * WORD_BITS:
            break
        left = written(placed.where(~F.col("fits")).select(*columns), "shard-deeper")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select(*columns, "shard", "shard_bytes", "shard_docs")


def write_shards(docs: DataFrame, folder: str, limit: int = SHARD_BYTES, depth: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs as read from the shards, with their shard; depth, shard_bytes and shard_docs of each shard) after writing them under folder.

    The shard's column is `shard`, with underscores before it where docs has such a column.
    """
    name = own_name(docs, "shard")
    own = written(docs.select(F.struct(*own_columns(docs)).alias("doc"), F.monotonically_increasing_id().alias("row")), "shard-docs")
    # the rows carry their texts, which are dealt once, by shard
    of = assigned(thin(own.select("doc.doc_id", "doc.text", "row", "doc"), F.col("row"), "doc"), limit, depth)
    # a letter before the bits, as the only shard of a small table has none
    named = of.select("doc", F.concat(F.lit("b"), "shard").alias("own_shard")).repartition("own_shard")
    named.select("doc.*", F.col("own_shard").alias(name)).write.option("compression", "zstd").partitionBy(name).parquet(folder)
    rows = docs.sparkSession.read.schema(T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])).parquet(folder)
    rows = rows.withColumn(name, F.expr(f"substring({name}, 2)"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    sizes = rows.groupBy(F.col(name).alias("shard")).agg(F.length(F.first(name)).alias("depth"), F.sum(size).alias("shard_bytes"), F.count("*").alias("shard_docs"))
    return rows, sizes


def op10(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, bytes, shard, depth, shard_bytes, shard_docs of every row, as read from the shards written."""
    name = own_name(docs, "shard")
    rows, sizes = write_shards(docs, new_path(docs.sparkSession, "shards"), limit)
    rows = rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), F.col(name).alias("shard"))
    return rows.join(broadcast_small(written(sizes, "shard-sizes")), "shard").select("doc_id", "bytes", "shard", "depth", "shard_bytes", "shard_docs")


def op10_sharding(spark, sf_dir):
    return op10(spark.read.parquet(f"{sf_dir}/documents.parquet"))
