"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A document is contaminated by a test item if it holds at least `threshold` of the item's distinct shingles of five
words (letters A-Z in lower case; an item of fewer words is one shingle).

Items are partitioned by size, in powers of two. Each partition has parameters of its own: h, the hits that a document
must have (an eighth of the partition's least size, 1 at least), and a bound, the largest hash in any of its sketches.
An item of q shingles is sketched by its q - ceil(tq) + h smallest hashes: what holds a share t of the item misses
q - ceil(tq) shingles at most, so h of the sketch at least are in it. A document's sketch for a partition is all its
hashes up to the partition's bound (at any length of the document, unlike a sketch of fixed size, in which a short item
would drown); the sketches for all partitions are nested, so one pass makes them. A document with h hits of an item's
sketch is a candidate, and the search misses nothing; candidates are verified with the shingles themselves.

Everything is DataFrame functions. Documents are told apart by content, so that copies are verified once. The
items' sketches and shingles go to all tasks only up to `BROADCAST_ROWS` rows.

Defined cases: null and blank texts and items have no shingles and match nothing; repeated items give one row per
item id and text; repeated rows of docs each get their rows; null ids are kept; empty tables give no rows; extra
columns are ignored by `contaminated` and pass through `clean`, whatever their names; a text of any length is one
array of words in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, lower_ascii, own_columns, words_of, written

WORDS = 5
THRESHOLD = 0.8


def _runs(words: Column, n: int, make) -> Column:
    """make(the n columns of words) for every n consecutive words of an array."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: make([F.get(words, i + k) for k in range(n)]))).otherwise(F.array())


def _hashes(hashed: Column, lengths: list[int]) -> Column:
    """Hashes of all shingles of these lengths, of an array of word hashes."""
    return F.concat(*[_runs(hashed, n, lambda w: F.xxhash64(*w)) for n in lengths])


def _shingles(words: Column, lengths: list[int]) -> Column:
    """The distinct shingles of these lengths, as text."""
    return F.array_distinct(F.concat(*[_runs(words, n, lambda w: F.concat_ws(" ", *w)) for n in lengths]))


def _hash_of(shingle: Column) -> Column:
    """The hash that `_hashes` gives a shingle."""
    words = F.split(shingle, " ")
    word = lambda i: F.xxhash64(F.get(words, F.lit(i)))
    n = F.size(words)
    out = F.xxhash64(*[word(i) for i in range(WORDS)])
    for m in range(1, WORDS):
        out = F.when(n == m, F.xxhash64(*[word(i) for i in range(m)])).otherwise(out)
    return out


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def hits_needed(size_class: Column) -> Column:
    """h of a partition: how many hashes of an item's sketch a document must have."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), size_class) / 8)).cast("int")


def sketched(items: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, list[int]]:
    """(item, item_id, length, n_item, size_class, shingle, hash, in_sketch by shingle of each item; the lengths that occur)."""
    words = words_of(lower_ascii(F.col("text")))
    own = items.select("item_id", F.xxhash64("text").alias("item"), words.alias("words")).where(F.size("words") > 0).dropDuplicates(["item_id", "item"])
    parts = F.when(F.size("words") >= WORDS, _shingles(F.col("words"), [WORDS])).otherwise(F.array(F.array_join("words", " ")))
    n = F.size("shingles")
    missed = n - F.ceil(n * F.lit(threshold) - 1e-9)
    rows = own.select("item_id", "item", F.least(F.size("words"), F.lit(WORDS)).alias("length"), parts.alias("shingles"))
    rows = rows.withColumns({"n_item": n.cast("long"), "size_class": F.floor(F.log2(n.cast("double")) + 1e-12).cast("int")})
    rows = rows.withColumn("kept", (missed + hits_needed(F.col("size_class"))).cast("int"))
    hashed = F.array_sort(F.transform("shingles", lambda s: F.struct(_hash_of(s).alias("hash"), s.alias("shingle"))))
    each = rows.select("item_id", "item", "length", "n_item", "size_class", "kept", F.posexplode(hashed).alias("rank", "s"))
    table = written(each.select("item_id", "item", "length", "n_item", "size_class", "s.shingle", "s.hash", (F.col("rank") < F.col("kept")).alias("in_sketch")), "items")
    return table, sorted(r[0] for r in table.select("length").distinct().collect())


def partitions(items: DataFrame) -> dict[int, int]:
    """The bound of each size partition: the largest hash of its sketches. At most one row per power of two."""
    return {r.size_class: r.bound for r in items.where("in_sketch").groupBy("size_class").agg(F.max("hash").alias("bound")).collect()}


def candidates(docs: DataFrame, items: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct k1, k2, item_id, item: documents, by content, that have the hits of an item's sketch that its partition asks for."""
    sketch = items.where("in_sketch").select("hash", "item_id", "item", "size_class")
    most = max(partitions(items).values(), default=-(2**63))
    own = docs.where("text IS NOT NULL").select(*_keys(F.col("text")), words_of(lower_ascii(F.col("text"))).alias("words"))
    own = own.select("k1", "k2", F.transform("words", lambda w: F.xxhash64(w)).alias("hashed"))
    own = own.select("k1", "k2", _hashes(F.col("hashed"), lengths or [WORDS]).alias("hashes"))
    low = own.select("k1", "k2", F.explode(F.filter("hashes", lambda h: h <= most)).alias("hash"))
    hits = low.join(broadcast_small(sketch), "hash").groupBy("k1", "k2", "item_id", "item", "size_class").agg(F.count_distinct("hash").alias("hits"))
    return hits.where(F.col("hits") >= hits_needed(F.col("size_class"))).select("k1", "k2", "item_id", "item")


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """k1, k2 (a document's content), item_id, n_item, n_shared, containment of each contaminated content and its item."""
    shingles, lengths = sketched(items, threshold)
    found = written(candidates(docs, shingles, lengths), "contaminated")
    wanted = found.select("k1", "k2").distinct()
    texts = docs.select(*_keys(F.col("text")), "text").join(broadcast_small(wanted), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.min("text").alias("text"))
    each = texts.select("k1", "k2", words_of(lower_ascii(F.col("text"))).alias("words")).select("k1", "k2", F.explode(_shingles(F.col("words"), lengths or [WORDS])).alias("shingle"))
    hits = each.join(broadcast_small(shingles.select("shingle", "item_id", "item", "n_item")), "shingle")
    counted = hits.groupBy("k1", "k2", "item_id", "item", "n_item").agg(F.count("*").alias("n_shared"))
    proven = counted.join(found.select("k1", "k2", "item", F.col("item_id").alias("_id")), ["k1", "k2", "item"], "inner").where(F.col("item_id").eqNullSafe(F.col("_id")))
    share = F.col("n_shared") / F.col("n_item")
    return proven.where(share >= threshold - 1e-12).select("k1", "k2", "item_id", "n_item", "n_shared", share.alias("containment"))


def found(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment of each contaminated row of docs and its item."""
    pairs = written(contaminated(docs, items, threshold), "leaks")
    rows = docs.select("doc_id", *_keys(F.col("text")))
    return rows.join(pairs, ["k1", "k2"]).select("doc_id", "item_id", "n_item", "n_shared", "containment")


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that no item contaminates, in its columns."""
    bad = written(contaminated(docs, items, threshold).select("k1", "k2").distinct(), "leaking")
    own = docs.select(F.struct(*own_columns(docs)).alias("doc"), *[F.when(F.col("text").isNotNull(), k).alias(n) for k, n in zip(_keys(F.col("text")), ("k1", "k2"), strict=True)])
    return own.join(broadcast_small(bad), ["k1", "k2"], "left_anti").select("doc.*")


def op2_decontamination(spark, sf_dir):
    return found(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
    WITH words AS (
        SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        UNION ALL
        SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
    lengths AS (SELECT DISTINCT least(len(w), 5) AS n FROM words WHERE side = 'i' AND len(w) > 0),
    places AS (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n AND (side = 'd' OR n = least(len(w), 5))),
    shingles AS (SELECT DISTINCT side, id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM places),
    items AS (SELECT id AS item_id, n, s, count(*) OVER (PARTITION BY id) AS n_item FROM shingles WHERE side = 'i')
    SELECT d.id AS doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
    FROM items JOIN shingles d ON d.side = 'd' AND d.n = items.n AND d.s = items.s
    GROUP BY d.id, item_id, n_item HAVING count(*) >= 0.8 * n_item"""
