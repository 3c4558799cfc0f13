"""Shapes of the input that once went wrong: few rows over many partitions, periodic texts, shared hashes, hot shingles."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_cases import expected_components, expected_removed, prose, table

from tidemark.llm import common, ngram_join, pii, repeats, substring_dedup

PERIODIC = ["alpha " * 40, "alpha beta " * 40, "a b c d e f g " * 12]


@pytest.mark.parametrize("partitions", [1, 8, 97])
@pytest.mark.parametrize("rows", [[(1, PERIODIC[0])], [(i, PERIODIC[i % 3] + (prose(i, 60) if i % 5 else "")) for i in range(50)]])
def test_substring_dedup_over_partitions(spark, partitions, rows):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(table(spark, rows)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == expected_removed(rows)


def test_buckets_beyond_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    shared = prose(70, 50)
    rows = [(i, f"{prose(i, 90)} {shared if i % 3 else ''} {prose(i + 300, 30)}") for i in range(40)]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed(table(spark, rows)).collect())
    assert got == expected_removed(rows)
    near = [(i, prose(i // 4, 90) + (" end" if i % 4 == 1 else "")) for i in range(40)]
    assert Counter(tuple(r) for r in ngram_join.components_of(table(spark, near)).collect()) == expected_components(near)


def test_texts_that_share_a_hash_get_keys_of_their_own(spark):
    rows = [(1, "one text"), (2, "two text"), (3, "two text"), (4, "longer text"), (5, None)]
    key, seen = substring_dedup.text_keys(table(spark, rows), lambda text: F.xxhash64(F.length(text)))
    assert sorted((r.copies, r.bytes) for r in seen.collect()) == [(1, 8), (1, 11), (2, 8)]
    keys = {r.doc_id: r.key for r in table(spark, rows).where("text IS NOT NULL").select("doc_id", key(F.col("text")).alias("key")).collect()}
    assert keys[2] == keys[3] and len(set(keys.values())) == 3


def test_hot_shingles_are_dealt_by_size_and_block(spark):
    # all sets share a few shingles that are rare elsewhere in them; hardly any link
    rng = random.Random(2)
    rows = [(i, " ".join(["the", "same", "old", "head", *(f"own{rng.randrange(10**9)}" for _ in range(8 + i % 40))])) for i in range(150)]
    rows += [(500 + i, " ".join([rows[i][1], "x"] if i % 2 else [rows[i][1]])) for i in range(0, 150, 7)]
    full = ngram_join._full_sets(table(spark, rows), ngram_join.sets(table(spark, rows)).select(F.concat(F.hex("k1"), F.hex("k2")).alias("node"), "t1", "t2").dropDuplicates(["node"]), 4)
    prefix = ngram_join.prefixes(common.written(full, "full")).unionByName(full.select("node", "n", F.lit(-5).cast("long").alias("shingle")))
    index, queries = ngram_join.dealt(prefix, full, shard=16)
    size = lambda x: max(r["count"] for r in x.groupBy("bin").count().collect())
    assert size(index) <= 48 and size(queries) <= 48
    sizes = {r.node: r.n for r in full.collect()}
    pairs = {(a.node, b.node) for a, b in ((a, b) for a in index.collect() for b in queries.collect() if a.bin == b.bin)}
    assert {(a, b) for a in sizes for b in sizes if 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])} <= pairs
    got = Counter(tuple(r) for r in ngram_join.components_of(table(spark, rows), shard=16).collect())
    assert got == expected_components(rows)


def test_small_tables_only_are_broadcast(spark):
    small = spark.createDataFrame([(i, "x" * 100) for i in range(50)], "a long, b string")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(common.broadcast_small(small))
    assert not hinted(common.broadcast_small(small, rows=49)) and not hinted(common.broadcast_small(small, size=5000))


def test_scratch_deletes_its_tables(spark):
    before = common.written(spark.range(3), "kept")
    with common.scratch(spark):
        within = common.written(spark.range(4), "gone")
        assert within.count() == 4
    assert before.count() == 3
    with pytest.raises(Exception, match="(?i)path.*not|not exist|FILE_NOT"):
        within.sparkSession.read.parquet(within.inputFiles()[0])


def joined_rows(df):
    """How many rows each join made for df's result, in ascending order."""
    df.collect()
    made, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan" or "QueryStage" in name:
            todo.append(node.executedPlan() if name == "AdaptiveSparkPlan" else node.plan())
            continue
        if "Join" in name:
            made.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return sorted(made)


def test_joins_of_disclosing_terms_do_not_grow_with_partitions(spark):
    rows = [(i, f"{prose(i, 20)} Zanzibaro met ann@example.org {prose(i + 500, 20)}") for i in range(40)] + [(100 + i, f"Zanzibaro {prose(900 + i, 60)}") for i in range(20)]

    def made(partitions):
        docs = table(spark, rows).repartition(partitions).select(F.monotonically_increasing_id().alias("ordinal"), "text")
        docs = common.written(docs, "docs")
        spread = docs.repartition(partitions)
        return joined_rows(pii.disclosing(common.written(pii.scan(docs), "scan"), spread))

    assert made(1) and made(1) == made(20)
