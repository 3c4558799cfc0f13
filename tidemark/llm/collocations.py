"""Phrase collocation mining.

A phrase is a run of words within one piece of a text. Which phrases can be frequent at all is read off a sketch of
their counts: one row of counters, dealt over the cluster by hash, so that it is as wide as the corpus needs and no
task or driver holds it whole. A counter is never less than the count of a phrase that falls on it, so the phrases
whose counter reaches the least count hold all frequent ones, and single words and parts of phrases as well.

Texts are cut into shards of bounded bytes. Each shard says which counters it touches, learns which of them are heavy,
compiles its own candidates into an Aho-Corasick automaton and scans its text for all matches, overlapping ones
included. The automaton reads each word as one to three symbols, few for frequent words, of which the first stands
nowhere else in a code, as a guard: it has far fewer states than one over letters. A phrase is no candidate if the
counter of a part of it stays below the least count, as it is found no more often than its parts. The counts of all shards are summed, and the least count,
the scores and the dominance of longer phrases are then decided on exact counts.

Defined cases: a null text is empty; a null language is `und`; empty texts and pieces have no words; repeated rows
count as often as they stand; an empty table gives no rows; extra columns are not read; a long text is cut into shards
between its pieces, a piece is never cut, however long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby, pairwise
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, written
from .grams import mixed, word_spans, words_at

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: A candidate is dropped if a longer one that holds it is found this many hundredths as often.
DOMINANCE = 50
#: Bytes of text in a shard, and of all texts for each part of the sketch, which has 2^BITS counters.
SHARD_BYTES, PART_BYTES, BITS = 5 << 20, 8 << 20, 21
#: Parts of the sketch whose phrases are summed in one group.
TOGETHER = 8
#: Phrases of at least 1 / COMMON of all words go to every task; there are at most COMMON of them of each length.
COMMON = 10_000

_UPPER = bytes(range(65, 91))
_PLAIN = bytes.maketrans(_UPPER + b".,;:!?\n\x0b\x0c\r\t", _UPPER.lower() + b"\n" * 10 + b" ")
_BREAK = np.zeros(256, bool)
_BREAK[[10, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

TEXTS = "shard long, lang string, payload binary"
SHARDS = "shard long, part int, lang string, payload binary"
COUNTS = "lang string, phrase string, f long"


def packed(buckets: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Ascending buckets, and a count of each, in few bytes: differences, byte by byte, compressed."""
    steps = np.diff(buckets, prepend=0).astype("<u4")
    planes = [*np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T[:3])]
    planes += [] if counts is None else [*np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(p.tobytes() for p in planes))


def unpacked(payload: bytes, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts: of no meaning where none were packed)."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), np.uint8).reshape(7 if counted else 3, -1).astype(np.int64)
    number = lambda of: sum(p << 8 * i for i, p in enumerate(of))
    return np.cumsum(number(planes[:3])), number(planes[3:])


#: A symbol of no code.
BREAK = "\uffff"


def code(rank: int) -> str:
    """One to three symbols for a number. The first symbol tells how many follow and is never one that follows, so codes are found in a row of codes where they were put only."""
    if rank < 128:
        return chr(257 + rank)
    rank -= 128
    if rank < 128 << 8:
        return chr(385 + (rank >> 8)) + chr(1 + (rank & 255))
    rank -= 128 << 8
    return chr(513 + (rank >> 16)) + chr(1 + (rank >> 8 & 255)) + chr(1 + (rank & 255))


class Phrases:
    """The phrases of up to `most` words of a text in plain form (pieces are lines): where each stands first, and how often it stands."""

    def __init__(self, plain: bytes, lang: str, most: int):
        data = np.frombuffer(plain, np.uint8)
        space = _BREAK[data]
        starts, ends = word_spans(space)
        coded = words_at(data, space, starts, ends).dictionary_encode()
        self.words = coded.dictionary.cast(pa.large_binary()).cast(pa.large_string())
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.line = np.searchsorted(np.flatnonzero(data == 10), starts)
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(self.words))
        self.seed = mixed(np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []
        self.number: list[np.ndarray] = []  # of the phrase that starts at each word (-1: none)
        at, key = np.arange(len(starts)), self.ids
        for n in range(1, most + 1):
            if n > 1:  # the number of the first n - 1 words, and the last word's, tell the phrase
                at = np.flatnonzero(self.line[n - 1 :] == self.line[: 1 - n])
                key = self.number[-1][at].astype(np.int64) * len(self.words) + self.ids[at + n - 1]
            _, first, which, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            self.found.append((at[first], counts))
            self.number.append(np.full(len(starts), -1, np.int32))
            self.number[-1][at] = which

    def keys(self, n: int, which: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The hash of each of these phrases of n words."""
        first = self.found[n - 1][0][which]
        out = np.repeat(self.seed + np.uint64(n), len(first))
        for k in range(n):
            out = mixed(out * _ODD + self.hash[self.ids[first + k]])
        return out

    def candidates(self, reached: np.ndarray, parts: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(numbers of the phrases of n words, their parts of the sketch), n from 1, of those whose counters, and their parts' counters, are among the reached."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for n, (first, _) in enumerate(self.found, 1):
            which = np.arange(len(first))
            if n > 1:
                shorter = self.number[n - 2]
                which = np.flatnonzero(held[shorter[first]] & held[shorter[first + 1]])
            part, bucket = places(self.keys(n, which), parts)
            place = part << BITS | bucket
            hit = reached[np.minimum(np.searchsorted(reached, place), len(reached) - 1)] == place if len(reached) else np.zeros(len(place), bool)
            out.append((which[hit], part[hit]))
            held = np.zeros(len(first), bool)
            held[which[hit]] = True
        return out

    def texts(self, n: int, which: np.ndarray, names: pa.LargeStringArray, between: str = " ") -> pa.LargeStringArray:
        """These phrases of n words, each word by its name."""
        first = self.found[n - 1][0][which]
        return pc.binary_join_element_wise(*(names.take(pa.array(self.ids[first + k])) for k in range(n)), pa.scalar(between, pa.large_string()))

    def codes(self, known: np.ndarray) -> list[str]:
        """A code for each of the known words, the more frequent the shorter, and a break for the others."""
        out = [BREAK] * len(self.words)
        for rank, i in enumerate(known[np.argsort(-self.found[0][1][known], kind="stable")].tolist()):
            out[i] = code(rank)
        return out

    def text(self, codes: list[str]) -> str:
        """The whole text in these codes, with a break between lines."""
        ends = np.flatnonzero(np.diff(self.line)) + 1
        return "".join(map([*codes, BREAK].__getitem__, np.insert(self.ids, ends, len(codes)).tolist()))


def places(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part of the sketch, counter in it) of each hash."""
    return ((keys >> np.uint64(BITS)) % np.uint64(parts)).astype(np.int64), (keys & np.uint64((1 << BITS) - 1)).astype(np.int64)


def cut_pieces(plain: bytes, most: int) -> Iterator[bytes]:
    """The text in stretches of whole lines, each of about `most` bytes or one line."""
    at = 0
    while len(plain) - at > most:
        end = plain.rfind(b"\n", at, at + most) + 1 or plain.find(b"\n", at + most) + 1 or len(plain)
        yield plain[at:end]
        at = end
    yield plain[at:]


def shards(docs: DataFrame, shard_bytes: int) -> DataFrame:
    """The text of each shard, in plain form, by language."""

    def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for k, texts in enumerate(gathered(batches)):
            payloads = [zstandard.ZstdCompressor(level=3).compress(b"\n".join(lines)) for lines in texts.values()]
            yield pa.RecordBatch.from_arrays([pa.array([number + k] * len(texts), pa.int64()), pa.array(texts, pa.string()), pa.array(payloads, pa.binary())], ["shard", "lang", "payload"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
        texts: dict[str, list[bytes]] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                for stretch in cut_pieces(text.as_py().translate(_PLAIN), shard_bytes):
                    if size and size + len(stretch) > shard_bytes:
                        yield texts
                        texts, size = {}, 0
                    texts.setdefault(lang, []).append(stretch)
                    size += len(stretch) + 1
        if texts:
            yield texts

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(sharded, TEXTS)


def touched_counters(texts: DataFrame, parts: int, min_count: int, most: int) -> DataFrame:
    """Of each shard: the counters of each part that it touches, each with its count."""

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c) for c in ("shard", "lang", "payload")), strict=True))
        for shard, texts in groupby(rows, lambda r: r[0].as_py()):
            keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, lang, payload in texts:
                phrases = Phrases(zstandard.ZstdDecompressor().decompress(payload.as_py()), lang.as_py(), most)
                keys += [phrases.keys(n) for n in range(1, most + 1)]
                counts += [c for _, c in phrases.found]
            part, bucket = places(np.concatenate(keys), parts)
            place, which = np.unique(part << BITS | bucket, return_inverse=True)
            total = np.minimum(np.bincount(which, np.concatenate(counts), len(place)), min_count).astype(np.int64)
            ends = np.searchsorted(place, np.arange(parts + 1) << BITS)
            held = np.flatnonzero(np.diff(ends))
            payloads = [packed(place[ends[p] : ends[p + 1]] & (1 << BITS) - 1, total[ends[p] : ends[p + 1]]) for p in held]
            yield pa.RecordBatch.from_arrays([pa.array([shard] * len(held), pa.int64()), pa.array(held, pa.int32()), pa.nulls(len(held), pa.string()), pa.array(payloads, pa.binary())], ["shard", "part", "lang", "payload"])

    return texts.mapInArrow(touched, SHARDS)


def heavy_counters(touched: DataFrame, min_count: int) -> DataFrame:
    """Of each shard and part: the counters touched that reach the least count over all shards."""

    def heavy(part: pa.Table) -> pa.Table:
        sums = np.zeros(1 << BITS, np.int64)
        payloads = part.column("payload")
        for p in payloads:
            buckets, counts = unpacked(p.as_py(), True)
            sums[buckets] += counts  # no bucket stands twice in a payload
        reached = sums >= min_count
        found = [b[reached[b]] for b in (unpacked(p.as_py(), True)[0] for p in payloads)]
        return pa.table([part.column("shard"), part.column("part"), pa.nulls(len(part), pa.string()), pa.array([packed(f) for f in found], pa.binary())], names=["shard", "part", "lang", "payload"])

    return touched.groupBy("part").applyInArrow(heavy, SHARDS)


def scanned(text: str, phrases: list[str]) -> np.ndarray:
    """How often each phrase stands in the text, both in codes, by one pass of an automaton; matches may overlap."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, p in enumerate(phrases):
        automaton.add_word(p, i)
    automaton.make_automaton()
    return np.bincount(np.fromiter(map(itemgetter(1), automaton.iter(text)), np.int64), minlength=len(phrases))


def packed_counts(phrases: list[str], counts: np.ndarray) -> bytes:
    """Phrases, in order, and their counts in few bytes."""
    plain = "\n".join(phrases).encode()
    planes = np.ascontiguousarray(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return zstandard.ZstdCompressor(level=6).compress(np.array([len(plain)], "<i8").tobytes() + plain + planes)


def unpacked_counts(payload: bytes) -> tuple[list[str], np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(payload)
    end = 8 + int(np.frombuffer(data, "<i8", 1)[0])
    planes = np.frombuffer(data[end:], np.uint8).reshape(8, -1)
    return data[8:end].decode().split("\n"), np.ascontiguousarray(planes.T).view("<i8").ravel().astype(np.int64)


def shard_counts(texts: DataFrame, heavy: DataFrame, parts: int, most: int) -> DataFrame:
    """Counts of each shard's candidates, packed by part of the sketch, and of its words (under the empty phrase)."""

    def count(texts: pa.Table, heavy: pa.Table) -> pa.Table:
        reached = [(p << BITS) + unpacked(b, False)[0] for p, b in zip(heavy.column("part").to_pylist(), heavy.column("payload").to_pylist(), strict=True)]
        reached = np.unique(np.concatenate(reached)) if reached else np.zeros(0, np.int64)
        out: list[tuple] = []
        for lang, blob in zip(texts.column("lang").to_pylist(), texts.column("payload"), strict=True):
            plain = zstandard.ZstdDecompressor().decompress(blob.as_py())
            phrases = Phrases(plain, lang, most)
            candidates = phrases.candidates(reached, parts)
            codes = phrases.codes(candidates[0][0])
            names, keys = (pa.chunked_array([phrases.texts(n, which, of, between) for n, (which, _) in enumerate(candidates, 1)]) for of, between in ((phrases.words, " "), (pa.array(codes, pa.large_string()), "")))
            groups = np.concatenate([[0], *(part // TOGETHER for _, part in candidates)])
            n_words, text = len(phrases.ids), phrases.text(codes)
            del phrases, candidates, codes  # before the automaton is made
            counts = np.concatenate([[n_words], scanned(text, keys.to_pylist()) if len(keys) else []])
            rows = pa.table([pa.array(groups), pa.chunked_array([pa.array([""], pa.large_string()), *names.chunks]), pa.array(counts.astype(np.int64))], names=["part", "phrase", "f"]).sort_by([("part", "ascending"), ("phrase", "ascending")])
            part, ordered, sums = rows.column("part").to_numpy(), rows.column("phrase").to_pylist(), rows.column("f").to_numpy()
            ends = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), len(part)]
            out += [(0, int(part[i]), lang, packed_counts(ordered[i:k], sums[i:k])) for i, k in pairwise(ends)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["shard", "part", "lang", "payload"])

    return texts.groupBy("shard").cogroup(heavy.groupBy("shard")).applyInArrow(count, SHARDS)


def summed(counts: DataFrame, min_count: int) -> DataFrame:
    """The sums over all shards of each language's phrases, of at least min_count, and of its words."""

    def add(part: pa.Table) -> pa.Table:
        langs, phrases, sums = [], [], []
        for lang, payload in zip(part.column("lang").to_pylist(), part.column("payload"), strict=True):
            names, values = unpacked_counts(payload.as_py())
            langs.append(pa.repeat(pa.scalar(lang, pa.string()), len(names)))
            phrases.append(pa.array(names, pa.string()))
            sums.append(pa.array(values, pa.int64()))
        whole = pa.table([pa.chunked_array(c) for c in (langs, phrases, sums)], names=["lang", "phrase", "f"]).group_by(["lang", "phrase"]).aggregate([("f", "sum")])
        return whole.rename_columns(["lang", "phrase", "f"]).filter((pc.field("f") >= min_count) | (pc.field("phrase") == ""))

    return counts.groupBy("part").applyInArrow(add, COUNTS)


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, most: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """lang, phrase, size (its words), f (its occurrences): all phrases of up to `most` words found min_count times or more, and under the empty phrase each language's number of words."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(total / part_bytes))
    texts = written(shards(docs, shard_bytes), "phrase-shards")
    heavy = heavy_counters(touched_counters(texts, parts, min_count, most), min_count)
    counts = summed(shard_counts(texts, heavy, parts, most), min_count)
    size = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return written(counts.select("lang", "phrase", size.alias("size"), "f"), "phrase-counts")


def part_of(first, last) -> F.Column:
    """The words of a phrase from number first to number last."""
    return F.array_join(F.slice("words", first, last - first + 1), " ")


def scored(counts: DataFrame, dominance: int = DOMINANCE, most: int = MAX_WORDS) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates among the counts (see `frequent`) that no longer one dominates."""
    words = counts.where("size > 0").select("lang", "phrase", "f")
    candidates = counts.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    sides = cuts.select("lang", F.col("phrase").alias("whole"), "f", "k", F.explode(F.array(F.struct(part_of(F.lit(1), F.col("k")).alias("part"), F.lit(True).alias("left")), F.struct(part_of(F.col("k") + 1, F.col("size")).alias("part"), F.lit(False).alias("left")))).alias("s"))
    sides = sides.select("lang", "whole", "f", "k", "s.*")
    total = counts.where("size = 0").agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    # what many phrases have in common is frequent itself; the other parts stand in few of them
    often = F.col("f") * COMMON >= total
    common, rare = (words.where(c).select("lang", F.col("phrase").alias("part"), F.col("f").alias("side")) for c in (often, ~often))
    key = ["lang", "part"]
    found = sides.join(F.broadcast(common), key).unionByName(sides.join(F.broadcast(common), key, "left_anti").join(rare, key))
    # one sum by phrase, all its cuts in a row, which stays where the longer phrases are met
    side = lambda k, left: F.max(F.when((F.col("k") == k) & (F.col("left") == left), F.col("side")))
    met = found.groupBy("lang", F.col("whole").alias("phrase")).agg(F.max("f").alias("a"), *(side(k, left).alias(f"{name}{k}") for k in range(1, most) for name, left in (("l", True), ("r", False))))

    def cut(k: int) -> F.Column:
        score = F.expr(f"(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(14,0)) * CAST(a AS DECIMAL(14,0))) div (CAST(l{k} AS DECIMAL(14,0)) * CAST(r{k} AS DECIMAL(14,0)))")
        return F.when(F.col(f"l{k}").isNotNull(), F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = met.select("lang", "phrase", "a", F.array_min(F.array(*map(cut, range(1, most)))).alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    spans = candidates.where("size > 2").withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1))).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    longer = spans.groupBy("lang", part_of(F.col("i"), F.col("i") + F.col("n") - 1).alias("phrase")).agg(F.max("f").alias("longer"))
    return best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(dominance) * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, most: int = MAX_WORDS, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language of docs (lang, text)."""
    counts = frequent(docs, min_count, most, **sizes)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts, most=most).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark, sf_dir):
    return collocations(documents(spark, sf_dir))


ORACLE = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) s(size)),
    f AS (SELECT lang, size, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
    c AS (SELECT lang, size, phrase, f, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND f >= 10),
    k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
    s AS (
        SELECT k.lang, k.phrase, k.size, k.f AS a, k.k, x.f AS l, y.f AS r, (1000000::HUGEINT * k.f * k.f) // (x.f * y.f) AS score
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1:k.size], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    o AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, f FROM c WHERE size = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), f FROM c WHERE size = 3),
    q AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = b.lang AND o.phrase = b.phrase AND 100 * o.f >= 50 * b.a)),
    t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM q)
    SELECT t.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n, score::BIGINT AS score FROM t JOIN n ON n.lang = t.lang WHERE rank <= 2000"""
