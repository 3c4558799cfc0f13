"""Packing documents into sequences by an order-preserving dynamic programme.

The tokens of the documents, in the order of the rows, are one stream, cut into windows of at most `window` tokens. A
window is padded up to `window`, unless its length is a power of two, and each cut within a document costs a truncation
penalty: little at the end of a sentence, more inside one. The programme chooses the cuts of least total cost. The best
window that ends at a cut is the least of (cost + position) over the cuts at most `window` before it, kept in a
monotone queue, so that the work grows with the number of possible cuts; windows of a power of two are looked up.

Cuts are possible at the ends of documents and sentences, every `STRIDE` tokens inside sentences of more than `LONG`,
and, in a task's last window, at every token. Each task packs its own rows and keeps no more than a few blocks of tokens
besides the documents it has just read, as only the last windows of a block are still open when the next one comes.

Tokens are those of a public tokenizer whose words end at white space, so that each distinct word is encoded once and
a long text in stretches; each document ends in `END`.

Defined cases: a null or blank text is a document of the end token alone; null and repeated ids and equal rows are
documents of their own; an empty table gives no rows; documents longer than a window are cut; extra columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import documents
from .grams import word_spans, words_at

WINDOW, END = 2048, 1
#: Costs, in tokens of padding: of a cut at a sentence's end, of one inside a sentence, and of each sequence.
SENTENCE, INSIDE, SEQUENCE = 8, 64, 64
LONG, STRIDE = 128, 16
#: Tokens that are cut at a time, windows at their end that stay open, bytes encoded at a time, distinct words kept.
BLOCK, OPEN, BYTES, WORDS = 1 << 19, 16, 8 << 20, 1 << 20
#: Words encoded together.
TOGETHER = 1000

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_MARK, _PLAIN = np.zeros(256, bool), np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_PLAIN[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BREAK = re.compile(rb"[ \t\n\x0b\x0c\r]")
#: A word that ends a sentence.
_STOP = re.compile("[.!?\u2026\u3002\uff01\uff1f][\"'\u201d\u2019)\\]]*$")

PIECES = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Tokens:
    """Ids, and whether a sentence ends behind each."""

    ids: np.ndarray
    stops: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, which: slice) -> Tokens:
        return Tokens(self.ids[which], self.stops[which])

    @staticmethod
    def joined(parts: list[Tokens]) -> Tokens:
        return Tokens(np.concatenate([p.ids for p in parts]), np.concatenate([p.stops for p in parts]))


def words_of(blob: bytes) -> tuple[pa.BinaryArray, np.ndarray]:
    """(the words of a text, in lower case, the marks behind one as a word of their own; where each begins).

    The tokenizer lowers letters itself and never joins a mark to a letter or digit before it, so that the words' ids
    are the text's, and there are fewer different words. A text that may name a special token keeps its capitals.
    """
    data = np.frombuffer(blob, np.uint8)
    space = _SPACE[data]
    starts, ends = word_spans(space)
    last = np.maximum.accumulate(np.where(space | _MARK[data], -1, np.arange(len(data))))[ends - 1] + 1
    cut = last[(last > starts) & (last < ends) & _PLAIN[data[np.maximum(last - 1, 0)]]]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return words_at(data if b"<|" in blob else _LOWER[data], space, starts, ends), starts


class Encoder:
    """Tokens of texts, each distinct word encoded once; the words seen are kept up to a number."""

    def __init__(self, tokenizer: str):
        self.tokenizer = Tokenizer.from_str(tokenizer)
        spelling = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(spelling.values()) + 1, bool)  # whether a token ends a run of letters, digits or others
        self.closes[[i for word, i in spelling.items() if word.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        """Forgets all words but the end token, which has the first place."""
        self.places: dict[bytes, int] = {}
        self.pool, self.begin, self.size, self.stop = np.array([END], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64), np.zeros(1, bool)

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts, one after the other; the number of each text's)."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for f in found for i in f), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def learn(self, words: list[bytes]) -> None:
        """Encodes new words. Runs of letters are encoded many at a time, as each has one token that closes it."""
        letters, others = [], []
        for w in words:
            (letters if (t := w.decode()).isalpha() else others).append((w, t))
        known, pools, sizes = [], [self.pool], []
        for at in range(0, len(letters), TOGETHER):
            group = letters[at : at + TOGETHER]
            ids, _ = self.encoded([" ".join(t for _, t in group)])
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group):
                known += [w for w, _ in group]
                pools.append(ids)
                sizes.append(np.diff(ends, prepend=0))
            else:  # a letter that lower case turns into more than letters
                others += group
        ids, size = self.encoded([t for _, t in others])
        known += [w for w, _ in others]
        self.places.update(zip(known, range(len(self.size), len(self.size) + len(known)), strict=True))
        size = np.concatenate([*sizes, size])
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.stop = np.concatenate([self.stop, np.zeros(len(known) - len(others), bool), np.fromiter((_STOP.search(t) is not None for _, t in others), bool, len(others))])
        self.pool = np.concatenate([*pools, ids])

    def whole(self, texts: list[bytes]) -> list[Tokens]:
        """The tokens of each text, with the end token."""
        blob = b"\n".join(texts) + b"\n"
        words, starts = words_of(blob)
        coded = words.dictionary_encode()
        seen = coded.dictionary.to_pylist()
        if len(self.places) + len(seen) > WORDS:
            self.clear()
        if new := [w for w in seen if w not in self.places]:
            self.learn(new)
        place = np.fromiter((self.places[w] for w in seen), np.int64, len(seen))[coded.indices.to_numpy()]
        line = np.searchsorted(np.flatnonzero(np.frombuffer(blob, np.uint8) == 10), starts)
        stop = self.stop[place] | (np.diff(line, append=-1) != 0)
        ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))  # words up to each text's end
        place, stop = np.insert(place, ends, 0), np.insert(stop, ends, True)
        size = self.size[place]
        after = np.cumsum(size)
        ids = self.pool[np.arange(after[-1]) - np.repeat(after - size, size) + np.repeat(self.begin[place], size)]
        stops = np.zeros(len(ids), bool)
        stops[np.maximum(after[stop] - 1, 0)] = True
        bounds = [0, *after[ends + np.arange(len(texts))].tolist()]
        return [Tokens(ids[b:e], stops[b:e]) for b, e in zip(bounds[:-1], bounds[1:], strict=True)]

    def documents(self, texts: Iterator[bytes]) -> Iterator[Tokens]:
        """The tokens of each text in turn; about BYTES of them are encoded at a time, and longer ones in stretches that end at white space."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            if group and size + len(text) > BYTES:
                yield from self.whole(group)
                group, size = [], 0
            if len(text) <= BYTES:
                group.append(text)
                size += len(text)
                continue
            *parts, last = [self.whole([s])[0] for s in stretches(text)]
            yield Tokens.joined([*(p[:-1] for p in parts), last])
        if group:
            yield from self.whole(group)


@lru_cache(maxsize=2)
def encoder(tokenizer: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
    return Encoder(tokenizer)


def stretches(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > BYTES and (found := _BREAK.search(text, at + BYTES)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def possible_cuts(stops: np.ndarray, ends: np.ndarray, window: int, dense: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(positions at which a stream may be cut, ascending from 0; the penalty of each).

    stops: where sentences end; ends: where documents end; dense: tokens at the stream's end with a cut at each.
    """
    penalty = np.full(len(stops) + 1, -1)
    penalty[1:][stops] = SENTENCE
    penalty[[0, *ends, len(stops)]] = 0
    at = np.flatnonzero(penalty >= 0)
    for i in np.flatnonzero(np.diff(at) > min(LONG, window)):
        penalty[at[i] + min(STRIDE, window) : at[i + 1] : min(STRIDE, window)] = INSIDE
    rest = penalty[max(0, len(stops) - dense) :] if dense else penalty[:0]
    rest[rest < 0] = INSIDE
    at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """The cuts of least cost among positions that lie at most `window` apart, the first and the last position included."""
    exact = [(np.zeros(0, int), np.zeros(0, int))]
    for k in range((window - 1).bit_length()):
        i = np.searchsorted(at, at - (1 << k))
        j = np.flatnonzero(at[i] == at - (1 << k))
        exact.append((j, i[j]))
    to, back = (np.concatenate(x) for x in zip(*exact, strict=True))
    order = np.argsort(to, kind="stable")
    to, back = [*to[order].tolist(), -1], back[order].tolist()
    place, price = at.tolist(), penalty.tolist()
    cost, come, queue, rank = [0] * len(place), [0] * len(place), [0], [place[0]]
    head = pair = 0
    for j in range(1, len(place)):
        p = place[j]
        low = p - window
        while place[queue[head]] < low:
            head += 1
        i = queue[head]
        least = rank[head] - low  # cost of i, and the padding of a window from i to j
        while to[pair] == j:
            if cost[back[pair]] < least:
                i = back[pair]
                least = cost[i]
            pair += 1
        least += price[j] + SEQUENCE
        cost[j], come[j] = least, i
        key = least + p
        while len(queue) > head and rank[-1] >= key:
            queue.pop()
            rank.pop()
        queue.append(j)
        rank.append(key)
    cuts = [len(place) - 1]
    while cuts[-1]:
        cuts.append(come[cuts[-1]])
    return [place[j] for j in reversed(cuts)]


class Packer:
    """Packs documents one after the other; sequences are numbered from `first`."""

    def __init__(self, window: int, first: int):
        self.window, self.next = window, first
        self.keys: list = []
        self.parts: list[Tokens] = []
        self.held, self.begun = 0, 0  # tokens held; of the first document, those packed already

    def add(self, key, tokens: Tokens) -> None:
        self.keys.append(key)
        self.parts.append(tokens)
        self.held += len(tokens)

    def pack(self, whole: bool) -> Iterator[tuple]:
        """(key, start, length, doc_tokens, sequence_id, offset, ids) of the pieces of all windows that are closed: all, if whole."""
        while self.held > (0 if whole else BLOCK):
            sizes = np.array([len(p) for p in self.parts])
            ends = np.cumsum(sizes) - self.begun
            begins = ends - sizes
            n = int(np.searchsorted(ends, BLOCK)) + 1  # documents that reach into the block
            block = Tokens.joined([self.parts[0][self.begun : self.begun + BLOCK], *(p[:BLOCK] for p in self.parts[1:n])])[:BLOCK]
            last = whole and len(block) == self.held
            inner = ends[ends <= len(block)]
            cuts = best_cuts(*possible_cuts(block.stops, inner, self.window, self.window if last else 0), self.window)
            if not last:
                cuts = cuts[: max(2, int(np.searchsorted(cuts, len(block) - OPEN * self.window)))]
            bounds = np.union1d(cuts, inner[inner < cuts[-1]])
            doc = np.searchsorted(ends, bounds[:-1], side="right")
            window = np.searchsorted(cuts, bounds[:-1], side="right") - 1
            for b, e, d, w in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), window.tolist(), strict=True):
                yield self.keys[d], b - int(begins[d]), e - b, int(sizes[d]), self.next + w, b - cuts[w], block.ids[b:e].astype("<u4").tobytes()
            self.next += len(cuts) - 1
            done = int(np.searchsorted(ends, cuts[-1], side="right"))
            self.begun = cuts[-1] - int(begins[done]) if done < len(sizes) else 0
            self.held -= cuts[-1]
            del self.keys[:done], self.parts[:done]


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """ident, start, length, doc_tokens, sequence_id, offset, ids (32-bit, little-endian) of each piece of a document.

    tokenizer: path, as the driver sees it, of a tokenizer file whose words end at white space.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    schema = T.StructType([T.StructField(ident, docs.schema[ident].dataType), *T.StructType.fromDDL(PIECES).fields])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, packer = encoder(sent.value), Packer(window, TaskContext.get().partitionId() << 32)
        kinds = [pa.null(), *[pa.int64()] * 5, pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema.names)

        for b in batches:
            kinds[0] = b.schema.field(0).type
            texts = (t.as_py() for t in b.column(1).cast(pa.binary()))
            for key, tokens in zip(b.column(0).to_pylist(), known.documents(texts), strict=True):
                packer.add(key, tokens)
                if packer.held > BLOCK:
                    yield batch(list(packer.pack(False)))
        if rows := list(packer.pack(True)):
            yield batch(rows)

    return docs.select(ident, F.coalesce(text, F.lit("")).alias("text")).mapInArrow(pack, schema)


def sequences(found: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """sequence_id, length, ids (32-bit, little-endian, padded) of the sequences that pieces make up."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda p: p.ids)
    whole = found.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p)).alias("ids"))
    power = F.bit_count("length") == 1
    return whole.withColumn("ids", F.when(power, F.col("ids")).otherwise(F.rpad("ids", 4 * window, F.lit(pad.to_bytes(4, "little")))))


def op13(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pieces(docs, tokenizer).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_packing(spark, sf_dir):
    return op13(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
