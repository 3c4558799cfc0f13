"""N-gram Jaccard join: T-occurrence search with DivideSkip.

Two documents link if the Jaccard similarity of their sets of distinct word shingles is at least `percent` hundredths.
A set of n shingles that links with another shares T = ceil(n percent / 100) of its own at least: it is a T-occurrence
query against the inverted lists of all others.

1. Each document becomes a set of shingle hashes, and documents with equal sets one node.
2. Of each set the smallest hashes are dealt out by hash, as packed arrays: n - T of them and n / 8 more, of which a
   link shares n / 8 (by both sets' sizes, about a tenth of the smaller). A set too few of whose smallest hashes occur
   in any other set links with nothing. This leaves few sets, and drops none that links.
3. The sets left are searched in groups that hold all their possible links: the components under shared prefixes,
   rarest shingles first. Within a group, DivideSkip puts the longest of a query's inverted lists aside, merges the
   short ones, and probes the long ones by binary search for what the short ones leave possible.
4. A group of more than `SHARD` sets is searched for the links of a few leaders first; the sets linked to the best
   leader are one class already and need no search among themselves. The others are dealt out by the shingles of their
   prefixes, with the sets that share them: two sets without a common prefix shingle never meet, however large the
   group. The sets of a prefix shingle that more than `SHARD` sets have are dealt by size besides (sets that link differ
   by one size class at most), then in blocks, so that a task holds one shard and one block. No link between two
   classes is lost.

The lists are merged by numpy (a stable sort of sorted runs) instead of a heap, which comes to the same counts.

Defined cases: null, empty and blank texts have an empty set, link with nothing and are their own component (its id
is their doc_id); fewer words than a shingle are one shingle; equal rows are linked; null doc ids link like others,
but are no component's id unless all of it has none; an empty table gives no rows; extra columns are ignored by
`components_of` and pass through `one_of_each`, whatever their names; a text of any length is one set, held whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import broadcast_small, own_columns, written
from .grams import flat, mixed, pieces, runs, word_hashes
from .repeats import as_batch, buckets_for, by_bucket, in_parts, one_by_one, read_parts

WORDS = 4
PERCENT = 85
#: Sets that one task searches at a time: of a large group, and of small ones together.
SHARD = 2048
BIN = 512
LEADERS = 8
#: Words that a task holds while it deals out their shingles.
UNIT_WORDS = 1 << 20
#: The share of T that DivideSkip's long lists get, by the logarithm of the longest list.
MU = 0.0085

SETS = "doc_id long, t1 long, t2 long, k1 long, k2 long, n long"
DEALT = "bucket int, names binary, keys binary"


def needed(n, percent: int = PERCENT):
    """T: the least overlap of a set of n shingles with any that links with it."""
    return (n * percent + 99) // 100


def sets_of(values: np.ndarray, lengths: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within each document; number of each document's)."""
    hashes, at = runs(values, lengths, words)
    ends = np.cumsum(lengths)
    of = np.searchsorted(ends, at, side="right")
    short = np.flatnonzero((lengths > 0) & (lengths < words))
    if len(short):
        whole = np.array([mixed(np.bitwise_xor.reduce(mixed(values[ends[d] - lengths[d] : ends[d]] + np.arange(1, lengths[d] + 1).astype(np.uint64)))[None] + np.uint64(lengths[d]))[0] for d in short], np.uint64)
        hashes, of = np.concatenate([hashes, whole]), np.concatenate([of, short])
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.bincount(of[new], minlength=len(lengths))


def keys_of(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set's content."""
    ends = np.cumsum(sizes)
    out = []
    for salt in (1, 2):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed(hashes + np.uint64(salt)))])
        out.append(mixed(total[ends] - total[ends - sizes] + sizes.astype(np.uint64)))
    return out[0], out[1]


def _tokens(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2"), word_hashes(text, lower=True).alias("w"))


def sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """SETS: each row of docs with its text's and its set's 128 bits and the set's size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, UNIT_WORDS):
            hashes, sizes = sets_of(*flat(b.column("w")), words)
            k1, k2 = keys_of(hashes, sizes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("t1"), b.column("t2"), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sizes)], ["doc_id", "t1", "t2", "k1", "k2", "n"])

    return _tokens(docs).mapInArrow(run, SETS)


def _prefix(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(sizes, sizes - needed(sizes, percent) + np.maximum(1, sizes // 8))


def _least_shared(n: F.Column, percent: int) -> F.Column:
    """How many of the smallest hashes of a set of n any link shares: by the smallest set that it may link with."""
    other = F.floor((n * percent + 99) / 100)
    return F.greatest(F.lit(1), F.floor(other / 8))


def possible(docs: DataFrame, buckets: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(k1, shared): of each set's smallest hashes, how many at least may occur in other sets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in pieces(batches, UNIT_WORDS):
            held.append(flat(b.column("w")))
            n += len(held[-1][0])
            if n >= UNIT_WORDS:
                yield from unit(held)
                held, n = [], 0
        if held:
            yield from unit(held)

    def unit(held: list) -> Iterator[pa.RecordBatch]:
        hashes, sizes = sets_of(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), words)
        keys = keys_of(hashes, sizes)[0]
        first = np.zeros(len(sizes), bool)
        first[np.unique(keys, return_index=True)[1]] = True  # equal sets once
        first &= sizes > 0
        begin = np.cumsum(sizes) - sizes
        rank = np.arange(len(hashes)) - np.repeat(begin, sizes)
        keep = (rank < np.repeat(_prefix(sizes, percent), sizes)) & np.repeat(first, sizes)
        names, of = hashes[keep], np.repeat(keys, sizes)[keep]
        order = np.argsort(names, kind="stable")
        names, of = names[order], of[order]
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(names)))
        many = np.repeat(size > 1, size)
        # what two sets of this unit share is counted here, and sent once, for the other units
        credited, counts = np.unique(of[many], return_counts=True)
        at = new | ~many
        names, of = names[at], np.where(many, np.uint64(0), of)[at]
        rows = packed(names, of, buckets)
        if len(credited):
            # a negative bucket marks counts instead of names
            rows += [(-1 - b, n, k) for b, k, n in packed(credited, counts.astype(np.uint64), buckets)]
        if rows:
            yield as_batch(rows, ["bucket", "names", "keys"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in one_by_one(batches):
            names, keys, out = [], [], []
            for b in rows:
                for k, x, y in zip(b.column("bucket").to_pylist(), b.column("names"), b.column("keys"), strict=True):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    if k < 0:
                        out.append((y, x))
                    else:
                        names.append(x)
                        keys.append(y)
            if names:
                out.append(borne(np.concatenate(names), np.concatenate(keys)))
            parts = packed(*totals(out), buckets)
            if parts:
                yield as_batch(parts, ["bucket", "keys", "counts"])

    def borne(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, how many of each one's names are other keys', too)."""
        order = np.lexsort((keys, names))
        names, keys = names[order], keys[order]
        other = np.ones(len(names), bool)
        other[1:] = (names[1:] != names[:-1]) | (keys[1:] != keys[:-1])
        names, keys = names[other], keys[other]
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        size = np.diff(np.append(np.flatnonzero(new), len(names)))
        known = np.logical_or.reduceat(keys == 0, np.flatnonzero(new))
        shared = np.repeat((size > 1) | known, size) & (keys != 0)
        found, counts = np.unique(keys[shared], return_counts=True)
        return found, counts.astype(np.uint64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in one_by_one(batches):
            x = read_parts(rows, {"keys": np.uint64, "counts": np.uint64})
            keys, counts = totals([(x["keys"], x["counts"])])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts.view(np.int64))], ["k1", "shared"])

    dealt = _tokens(docs).select("w").mapInArrow(deal, DEALT)
    met = by_bucket(dealt, buckets).mapInArrow(meet, "bucket int, keys binary, counts binary")
    return by_bucket(met, buckets).mapInArrow(gather, "k1 long, shared long")


def totals(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, the sum of each one's counts)."""
    keys = np.concatenate([*[x[0] for x in parts], np.zeros(0, np.uint64)])
    counts = np.concatenate([*[x[1] for x in parts], np.zeros(0, np.uint64)])
    found, of = np.unique(keys, return_inverse=True)
    return found, np.bincount(of, counts, len(found)).astype(np.uint64)


def packed(keys: np.ndarray, counts: np.ndarray, buckets: int) -> list[tuple]:
    """Keys and counts as packed arrays, one row for each of the keys' buckets."""
    return list(in_parts((mixed(keys) % np.uint64(buckets)).astype(np.int32), buckets, keys, counts))


def _full_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, n, shingles) of the nodes (node, t1, t2): their sets, from one text of each."""
    keyed = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), F.col("text")).alias("t2"), "text")
    texts = keyed.join(broadcast_small(nodes.select("t1", "t2")), ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.min("text").alias("text"))
    rows = texts.join(nodes, ["t1", "t2"]).select("node", word_hashes(F.col("text"), lower=True).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, UNIT_WORDS):
            hashes, sizes = sets_of(*flat(b.column("w")), words)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sizes), lists], ["node", "n", "shingles"])

    return rows.mapInArrow(run, "node string, n long, shingles array<long>")


def prefixes(full: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, n, shingle): the rarest n - T + 1 shingles of each set, of those that occur in two sets at least."""
    each = full.select("node", "n", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    known = each.join(often, "shingle")
    of = Window.partitionBy("node")
    # shingles of no other set are rarer than all others
    rank = F.row_number().over(of.orderBy("df", "shingle")) + F.col("n") - F.count("*").over(of)
    least = F.floor((F.col("n") * percent + 99) / 100)
    return known.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - least + 1).select("node", "n", "shingle")


class Index:
    """Inverted lists of sets (sorted arrays of hashes)."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        tokens, of = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, self.members = tokens[order], of[order]
        self.names, first = np.unique(tokens, return_index=True)
        self.cuts = np.append(first, len(tokens))

    def search(self, query: np.ndarray, percent: int = PERCENT) -> np.ndarray:
        """The members whose overlap with the query makes them link with it: DivideSkip."""
        n = len(query)
        t = needed(n, percent)
        at = np.searchsorted(self.names, query)
        at = at[self.names[np.minimum(at, len(self.names) - 1)] == query] if len(self.names) else at[:0]
        if len(at) < t:
            return np.zeros(0, np.int64)
        length = self.cuts[at + 1] - self.cuts[at]
        longest = int(length.max())
        n_long = min(t - 1, int(t / (MU * np.log2(longest + 1) + 1)), len(at))
        order = np.argsort(length, kind="stable")
        short, long = at[order[: len(at) - n_long]], at[order[len(at) - n_long :]]
        merged = np.sort(np.concatenate([self.members[self.cuts[i] : self.cuts[i + 1]] for i in short] or [np.zeros(0, np.int64)]), kind="stable")
        found, count = np.unique(merged, return_counts=True)
        fits = (100 * self.sizes[found] >= percent * n) & (100 * n >= percent * self.sizes[found]) & (count >= t - len(long))
        found, count = found[fits], count[fits]
        for k, i in enumerate(long):
            if not len(found):
                break
            members = self.members[self.cuts[i] : self.cuts[i + 1]]
            place = np.searchsorted(members, found)
            count = count + (members[np.minimum(place, len(members) - 1)] == found)
            if k % 64 == 63:
                may = count >= t - (len(long) - k - 1)
                found, count = found[may], count[may]
        return found[100 * count >= percent * (n + self.sizes[found] - count)]


def searched(index: DataFrame, queries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b): links of the queries with the index of the same bin; both have bin, node, shingles.

    Of the links of a query with sets that already are in one class, one is returned.
    """

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": []}, dtype=str)
        nodes = list(left.node)
        own = Index([np.asarray(s).view(np.uint64) for s in left.shingles])
        root = list(range(len(nodes)))
        place = {x: i for i, x in enumerate(nodes)}

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        links = []
        for node, s in zip(right.node, right.shingles, strict=True):
            me, seen = place.get(node), set()
            for j in own.search(np.asarray(s).view(np.uint64), percent):
                r = top(int(j))
                if j == me or r in seen or (me is not None and r == top(me)):
                    continue
                links.append((node, nodes[j]))
                if me is None:
                    seen.add(r)
                else:
                    root[r] = top(me)
        return pd.DataFrame(links, columns=["a", "b"], dtype=str)

    return index.select("bin", "node", "shingles").groupBy("bin").cogroup(queries.select(*[F.col(c).alias(c) for c in ("bin", "node", "shingles")]).groupBy("bin")).applyInPandas(run, "a string, b string")


def _range(n: F.Column) -> F.Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def dealt(prefix: DataFrame, rest: DataFrame, percent: int = PERCENT, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(bin, node) of the index and of the queries: the nodes of rest meet all those that share a prefix shingle with them."""
    asked = prefix.join(rest.select("node"), "node", "left_semi")
    held = written(prefix.join(asked.select("shingle").distinct(), "shingle", "left_semi"), "ngram-held")
    # shingles of the same sets count as one
    alike = held.groupBy("shingle").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"))
    one = written(alike.where("members > 1").groupBy("members", "x", "y").agg(F.min("shingle").alias("shingle")).select("shingle", "members"), "ngram-shingles")
    bins = max(1, -(-(one.where(F.col("members") <= shard).agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]) // shard))
    few = F.col("members") <= shard
    index, queries = held.join(one, "shingle"), asked.join(one, "shingle")
    together = lambda x: x.where(few).select(F.concat(F.lit("t"), F.pmod(F.xxhash64("shingle"), F.lit(bins)).cast("string")).alias("bin"), "node").distinct()
    # a little more than the ratio of two sizes that may link: their classes are neighbours
    size = F.floor(F.log("n") / (max(math.log(100 / percent), 1e-6) * (1 + 1e-9)))
    many = index.where(~few).withColumn("class", size)
    ask = queries.where(~few).withColumn("class", F.explode(F.array(size - 1, size, size + 1)))
    shards = many.groupBy("shingle", "class").agg(F.ceil(F.count("*") / shard).cast("int").alias("shards"))
    blocks = ask.groupBy("shingle", "class").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks"))
    grid = shards.join(blocks, ["shingle", "class"])
    own = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "node"), F.col(n)).cast("int")
    place = F.concat_ws(":", "shingle", "class", "i", "j").alias("bin")
    many = many.join(grid, ["shingle", "class"]).select("*", own("shard", "shards").alias("i"), _range(F.col("blocks")).alias("j")).select(place, "node")
    ask = ask.join(grid, ["shingle", "class"]).select("*", own("block", "blocks").alias("j"), _range(F.col("shards")).alias("i")).select(place, "node")
    return together(index).unionByName(many), together(queries).unionByName(ask)


def links(full: DataFrame, percent: int = PERCENT, shard: int = SHARD) -> DataFrame:
    """(a, b): links between the sets (node, n, shingles), enough of them to give all components."""
    prefix = written(prefixes(full, percent), "prefixes")
    first = prefix.groupBy("shingle").agg(F.min("node").alias("b"), F.count("*").alias("c")).where("c > 1")
    groups = graph.components(prefix.join(first, "shingle").select(F.col("node").alias("a"), "b"))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    placed = written(groups.join(sizes, "component").join(full, "node").select("node", "shingles", "component", "size"), "ngram-groups")
    small = placed.where(F.col("size") <= shard)
    bins = max(1, -(-small.count() // min(BIN, shard)))
    small = small.withColumn("bin", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(bins)).cast("string")))
    out = searched(small, small, percent)
    large = placed.where(F.col("size") > shard)
    if not large.isEmpty():
        shards = F.ceil(F.col("size") / shard).cast("int")
        name = lambda i: F.concat_ws(":", "component", i.cast("string"))
        index = large.withColumn("bin", name(F.pmod(F.xxhash64("node"), shards)))
        tops = large.groupBy("component").agg(*[F.min_by("node", F.xxhash64(F.lit(i), "node")).alias(f"l{i}") for i in range(LEADERS)])
        tops = tops.select("component", F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)]))).alias("node"))
        leaders = large.join(tops, ["component", "node"], "left_semi").withColumn("bin", F.explode(F.transform(F.sequence(F.lit(0), shards - 1), name)))
        led = written(searched(index, leaders, percent).where("a <> b"), "led")
        of = led.join(large.select(F.col("node").alias("a"), "component"), "a")
        best = of.groupBy("component", "a").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("a", F.struct("n", "a")).alias("a"))
        done = led.join(best, "a", "left_semi").select(F.col("b").alias("node")).unionByName(best.select(F.col("a").alias("node")))
        rest = large.join(done, "node", "left_anti")
        index, queries = (x.join(large.select("node", "shingles"), "node") for x in dealt(prefix, rest, percent, shard))
        out = out.unionByName(led).unionByName(searched(index, queries, percent))
    return out.where("a <> b")


def components_of(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, shard: int = SHARD) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per row of docs."""
    own = written(sets(docs, words), "ngram-sets")
    node = F.concat(F.lpad(F.hex("k1"), 16, "0"), F.lpad(F.hex("k2"), 16, "0"))
    # 8 bytes for each hash of a text's words
    buckets = buckets_for(docs, 8 * own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    kept = possible(docs, buckets, words, percent)
    nodes = own.where("n > 0").groupBy("k1", "k2", "n").agg(F.min(F.struct("t1", "t2")).alias("t"))
    nodes = nodes.join(kept, "k1").where(F.col("shared") >= _least_shared(F.col("n"), percent)).select(node.alias("node"), "t.t1", "t.t2")
    full = written(_full_sets(docs, written(nodes, "ngram-nodes"), words), "ngram-full")
    found = graph.components(links(full, percent, shard))
    least = own.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("least")).where("n > 0").withColumn("node", node)
    named = least.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = named.join(ids, "component").select("k1", "k2", "component_id")
    rows = own.join(by_set, ["k1", "k2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, in its columns, with one document of each component: that with the component's id.

    Of rows that share that id, one stays; rows without an id and rows that link with nothing all stay.
    """
    own = written(docs.select(F.struct(*own_columns(docs)).alias("doc"), F.monotonically_increasing_id().alias("row")), "ngram-docs")
    found = components_of(own.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text")), words, percent)
    ids = own.select("row", F.col("doc.doc_id").alias("doc_id"))
    first = ids.join(found.select(F.col("doc_id").alias("row"), "component_id"), "row").groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    return own.join(first.select("row"), "row", "left_semi").select("doc.*")


def op8_ngram_join(spark, sf_dir):
    return components_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0),
    shingles AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 3], ' ')) AS s FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS MATERIALIZED (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS MATERIALIZED (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
    edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = d.doc_id) AS component_id
    FROM documents d LEFT JOIN sizes USING (doc_id)"""
