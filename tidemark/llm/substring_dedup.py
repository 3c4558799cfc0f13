"""Substring dedup by recompression.

A window of `window` words that also starts elsewhere is a repeat; every word that a repeat covers is removed.

Documents are compressed in rounds, the same everywhere: first runs of one word become symbols, then, six times,
pairs of neighbouring symbols whose left one falls on the left side and whose right one on the right side of a coin
that the symbols' names toss in that round. A symbol's name is a hash of its parts, so that a name is global without
a dictionary. Symbols of `FROZEN` words pair no more. Equal windows get equal symbols but at their edges: a window's
first symbol may pair with what stands before it only if it is a right one, its last with what follows only if it is
a left one. What is left between the edges after all rounds is the window's interior, the same wherever it stands.

1. All symbols of the last round are counted over the corpus (a window without an interior is counted itself). A
   window of whose interior any symbol is borne once in the corpus is no repeat.
2. The windows left are verified: the 128-bit hashes of their words are counted in the same way.
3. The texts that have repeats are written anew.

Texts that occur several times are one text in all this; every window of theirs is a repeat. A text's key has 64 bits;
keys that two texts share (told by 128 bits) are given out anew, so that no text is taken for another.

Defined cases: null, empty and blank texts have no words; texts shorter than a window lose nothing; equal rows lose
everything; null and repeated ids get a row each; an empty table gives no rows; extra columns are ignored by
`removed`, and pass through `deduplicated`, whatever their names; a text of any length is compressed whole, in the
memory of one task. Symbols are compared by 64 bits, which only lets windows through to their verification.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_small, own_columns, own_name, words_of, written
from .grams import flat, mixed, word_hashes
from .repeats import buckets_for, repeated

WINDOW = 35
ROUNDS = 6
#: Words from which on a symbol is not paired.
FROZEN = 6
#: Odd numbers, one for each 64 bits of a window's hash.
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """Hash of the window words from each start."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    total = np.append(np.uint64(0), np.cumsum(mixed(hashes ^ base) * _powers(base, len(hashes))[:-1]))
    return mixed((total[starts + window] - total[starts]) * _powers(inverse, len(hashes))[starts])


class Recompressed:
    """The last round's symbols of a unit of documents, and the interiors of its windows."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray, window: int = WINDOW):
        ends = np.cumsum(lengths)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        n = len(hashes)
        self.starts = np.flatnonzero(np.arange(n) + window <= np.repeat(ends, lengths))  # of the windows
        self.hashes, self.window = hashes, window
        # runs of one word
        new = np.ones(n, bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, n))
        name = mixed(hashes[at] ^ mixed(size.astype(np.uint64)))
        of = np.cumsum(new) - 1
        doc = doc[at]
        low, high = of[self.starts] + 1, of[self.starts + window - 1] - 1  # a run may go on outside
        full = low <= high
        low, high = np.where(full, low, 0), np.where(full, high, 0)
        for r in range(ROUNDS):
            free = size < FROZEN
            right = (mixed(name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)
            first = np.zeros(len(name), bool)
            first[:-1] = (free & ~right)[:-1] & (free & right)[1:] & (doc[1:] == doc[:-1])
            second = np.append(False, first[:-1])
            low, high = low + (free & right)[low], high - (free & ~right)[high]
            full &= low <= high
            moved = np.cumsum(~second) - 1
            low, high = np.where(full, moved[np.where(full, low, 0)], 0), np.where(full, moved[np.where(full, high, 0)], 0)
            pairs = np.flatnonzero(first)
            name, size = name.copy(), size.copy()
            name[pairs] = mixed(name[pairs] + mixed(name[pairs + 1] ^ np.uint64(0x5851F42D4C957F2D)))
            size[pairs] += size[pairs + 1]
            name, size, doc, at = name[~second], size[~second], doc[~second], at[~second]
        self.names, self.at, self.doc, self.low, self.high, self.full = name, at, doc, low, high, full

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(name, index of the first word; of a window that is its own anchor, with the top bit set) of what is counted."""
        inside = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(inside, self.low[self.full], 1)
        np.subtract.at(inside, self.high[self.full] + 1, 1)
        used = np.cumsum(inside[:-1]) > 0
        alone = self.starts[~self.full]
        own = window_hashes(self.hashes, alone, self.window) ^ np.uint64(0xA5A5A5A5)
        return np.concatenate([self.names[used], own]), np.concatenate([self.at[used], alone | (1 << 62)])

    def possible(self, shared: np.ndarray, shared_windows: np.ndarray) -> np.ndarray:
        """Starts of the windows that may be repeats, by the flags of the words that begin a shared symbol and of shared windows."""
        lone = np.append(0, np.cumsum(~shared[self.at]))
        fits = np.where(self.full, lone[np.where(self.full, self.high, -1) + 1] == lone[self.low], shared_windows[self.starts])
        return self.starts[fits]


def _unit(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lengths, begin of each document, keys) of a unit; equal texts once."""
    parts = [flat(b.column("w")) for b in batches]
    keys = np.concatenate([b.column("key").to_numpy() for b in batches]).view(np.uint64)
    hashes, lengths = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.zeros(len(keys), bool)
    first[np.unique(keys, return_index=True)[1]] = True
    if not first.all():
        hashes, lengths, keys = hashes[np.repeat(first, lengths)], lengths[first], keys[first]
    return hashes, lengths, np.cumsum(lengths) - lengths, keys


def text_keys(docs: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> tuple[Callable[[Column], Column], DataFrame]:
    """(the 64-bit key of a text, and key, copies, bytes of every text that is not null).

    Of n texts about n**2 / 2**65 pairs share a hash (two of 10**10 texts); those hashes, and no others, come to the driver.
    """
    shared: list[list[int]] = []

    def key(text: Column) -> Column:
        out = hashed(text)
        for i, known in enumerate(shared):
            out = F.when(out.isin(known), F.xxhash64(F.lit(i), text)).otherwise(out)
        return out

    rows = docs.where("text IS NOT NULL").select("text")
    while True:
        own = rows.select(key(F.col("text")).alias("key"), F.xxhash64(F.lit(7), "text").alias("second"), F.octet_length("text").cast("long").alias("bytes"))
        seen = written(own.groupBy("key").agg(F.count("*").alias("copies"), F.max("bytes").alias("bytes"), F.min("second").alias("least"), F.max("second").alias("most")), "text-keys")
        more = [r.key for r in seen.where("least <> most").select("key").collect()]
        if not more:
            return key, seen.select("key", "copies", "bytes")
        shared.append(more)


def shared_symbols(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, places) of the texts' symbols, and windows without symbols (top bit set), that occur more than once."""

    def named(batches):
        hashes, lengths, begin, keys = _unit(batches)
        x = Recompressed(hashes, lengths, window)
        names, at = x.anchors()
        alone = at >> 62
        at = at & ((1 << 62) - 1)
        of = np.searchsorted(begin + lengths, at, side="right")
        return [names], keys[of], (at - begin[of]) | (alone << 31)

    return repeated(docs.where(F.size("w") >= window).select("key", "w"), named, buckets)


def repeats(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """(key, places): starts of the repeats of the texts (key, w, places of their shared symbols)."""

    def named(batches):
        hashes, lengths, begin, keys = _unit(batches)
        place = dict(zip(keys.tolist(), begin.tolist(), strict=True))
        shared, alone = np.zeros(len(hashes) + 1, bool), np.zeros(len(hashes) + 1, bool)
        for b in batches:
            for key, p in zip(b.column("key").to_numpy().view(np.uint64).tolist(), b.column("places"), strict=True):
                at = np.frombuffer(p.as_buffer(), np.uint32)
                top = (at >> np.uint32(31)).astype(bool)
                shared[place[key] + at[~top].astype(np.int64)] = True
                alone[place[key] + (at[top] & np.uint32(0x7FFFFFFF)).astype(np.int64)] = True
        starts = Recompressed(hashes, lengths, window).possible(shared, alone)
        of = np.searchsorted(begin + lengths, starts, side="right")
        return [window_hashes(hashes, starts, window, base) for base in _BASES], keys[of], starts - begin[of]

    return repeated(texts.select("key", "w", "places"), named, buckets, len(_BASES))


def _covered(places, n: int, window: int) -> np.ndarray:
    """Flags of the words that windows from these places cover."""
    edge = np.zeros(n + 1, np.int64)
    at = np.frombuffer(places, np.uint32).astype(np.int64)
    edge[at] += 1
    edge[at + window] -= 1
    return np.cumsum(edge[:-1]) > 0


def rewritten(docs: DataFrame, key: Callable[[Column], Column], seen: DataFrame, window: int = WINDOW, keep_text: bool = False) -> DataFrame:
    """(key, n_removed, kept_sha256, and kept if keep_text) of the texts, by key, that hold repeats of any text."""
    buckets = buckets_for(docs, seen.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    keyed = docs.where("text IS NOT NULL").select(key(F.col("text")).alias("key"), "text")
    symbols = written(shared_symbols(keyed.select("key", word_hashes(F.col("text")).alias("w")), window, buckets), "symbols")
    texts = keyed.join(broadcast_small(symbols.select("key")), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    texts = written(texts.join(symbols, "key"), "repeat-texts")
    found = repeats(texts.select("key", word_hashes(F.col("text")).alias("w"), "places"), window, buckets)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, text, places in zip(b.column("key").to_pylist(), b.column("text"), b.column("places"), strict=True):
                words = text.as_buffer().to_pybytes().split()
                gone = _covered(places.as_buffer(), len(words), window)
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((k, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8") if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["key", "n_removed", "kept_sha256", "kept"])

    return texts.select("key", "text").join(found, "key").mapInArrow(rewrite, "key long, n_removed long, kept_sha256 string, kept string")


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs."""
    key, seen = text_keys(docs)
    narrow = written(rewritten(docs, key, seen, window).drop("kept"), "rewritten")
    copied = written(seen.where("copies > 1").select("key"), "copied")
    words = words_of(F.col("text"))
    rows = docs.select("doc_id", F.when(F.col("text").isNotNull(), key(F.col("text"))).alias("key"), F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("whole"))
    rows = rows.join(broadcast_small(narrow), "key", "left").join(broadcast_small(copied).withColumn("again", F.lit(True)), "key", "left")
    gone = F.coalesce("again", F.lit(False)) & (F.col("n_words") >= window)
    return rows.select(
        "doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, in its columns; texts that hold repeats are their kept words, joined by spaces."""
    key, seen = text_keys(docs)
    texts = rewritten(docs, key, seen, window, keep_text=True).select("key", "kept")
    again = written(seen.where("copies > 1").select("key"), "copied").withColumn("again", F.lit(True))
    changes = written(texts.join(again, "key", "full"), "rewritten")
    own = docs.select(F.struct(*own_columns(docs)).alias("doc"), "text", F.when(F.col("text").isNotNull(), key(F.col("text"))).alias("key"))
    own = own.join(changes, "key", "left")
    gone = F.coalesce("again", F.lit(False)) & (F.size(words_of(F.col("text"))) >= window)
    text = F.when(gone, "").otherwise(F.coalesce("kept", "text"))
    return own.select(F.col("doc").withField("text", text).alias("doc")).select("doc.*")


def op5_substring_dedup(spark, sf_dir):
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
    WITH words AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    starts AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35),
    windows AS MATERIALIZED (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM starts),
    again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
    hit AS (SELECT r, i FROM windows SEMI JOIN again USING (h)),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM hit),
    lists AS (SELECT r, list(i) AS g FROM gone GROUP BY r),
    each AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words WHERE len(w) > 0),
    kept AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.i) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.r = g.r AND e.i = g.i GROUP BY e.r)
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (r)"""
