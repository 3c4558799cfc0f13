"""A corpus pipeline of five of the operators: each stage's rows are written as Parquet and read by the next.

Defined cases, in every stage: null, empty and very long texts, null and repeated ids, repeated rows, an empty table and
extra columns of any name crash nothing; extra columns pass through with their values up to the last stage. A null or
blank text fails the quality rules; what each stage does with the others stands in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, mixing, ngram_join, quality, sharding
from tidemark.llm.common import documents, new_path, scratch, written_at


#: Near copies of the join stage: Jaccard similarity of at least NEAR_PERCENT hundredths over shingles of NEAR_WORDS words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep."""
    field = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.filtered(docs, field)


def join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return ngram_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until their sources meet the target weights."""
    return mixing.mixed_documents(docs)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the documents in shards; the shard of every document, as read from them."""
    return sharding.op10(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", join_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mix_stage),
    ("sharding", shard_stage),
]

#: The mix is seeded by Spark's hash, and the quality rules are a trained model; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on documents. What a stage writes besides its rows is deleted once they are written, but for the last."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        with scratch(spark):
            docs = written_at(stage(spark, docs, sf_dir), path)
    return STAGES[-1][1](spark, docs, sf_dir)
