"""Quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a text as content or boilerplate, decoded by
Viterbi; a document is retained if enough of its words stand in content lines and no base rule rejects it.

Labels are given for documents, not lines, so the field is trained with latent line labels: a first guess from the
line features that good and bad documents have in common, then, in turn, the field is fitted to the guess and the
guess is made anew by the field, held to the documents' labels (of a good one most words are content, of a bad one few
are; which lines these are is the field's choice). So lines of both kinds are learnt within one document, and what
follows what. At most `SAMPLE_DOCS` labelled documents are used, chosen by hash, and of each at most `SAMPLE_LINES`
lines, in stretches spread over the whole; everything else covers all lines of all documents.

Defined cases: a null or blank text has no lines, no words and fails the base rule; lines without a word are
not in the sequence; without labels of both kinds every line is content, and only the base rules decide;
several labels of one document: the smallest counts; several texts of one labelled id: one of them, by hash, is
trained on; null doc ids carry no label; repeated rows get equal results; an empty table gives no rows; further
columns pass through `filtered` unread, whatever their names; texts and lines of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 2000
SAMPLE_LINES = 500
MIN_WORDS = 50
MIN_CONTENT = 0.5
#: Longest run of lines that training sees as one sequence; decoding has no such bound.
TRAIN_LINES = 50
#: Least share of content words in a good document, and greatest in a bad one, that the line labels are held to.
GOOD_CONTENT, BAD_CONTENT = 0.6, 0.4
#: Turns of fitting and labelling, and steps of the ascent in each.
SWEEPS, STEPS = 6, 40
SYMBOLS = b"#*$%&|<>"

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, content_words long, base_failed boolean, kept boolean"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_CLASSES = {
    "space": _table(b" \t\n\x0b\x0c\r"),
    "symbol": _table(SYMBOLS),
    "upper": _table(bytes(range(65, 91))),
    "lower": _table(bytes(range(97, 123)) + bytes(range(128, 256))),
    "digit": _table(bytes(range(48, 58))),
    "mark": _table(b"!?.,;:()[]{}\"'"),
    "shout": _table(b"!"),
    "point": (np.arange(256) & 0xC0) != 0x80,  # bytes that begin a code point
}
_SHARES = ("symbol", "upper", "digit", "mark", "shout")
#: Upper bounds of the bins that a line's shares and sizes fall into.
_SHARE_BINS = np.array([0.0, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7])
_COUNT_BINS = np.array([1, 2, 4, 8, 16, 32, 64, 128])
_LENGTH_BINS = np.array([2, 3, 4, 5, 6, 7, 9, 12])
_BINS = [*[_SHARE_BINS] * len(_SHARES), _COUNT_BINS, _LENGTH_BINS]
_SIZES = [*(len(b) + 1 for b in _BINS), 2, 2]
N_FEATURES = sum(_SIZES)
_OFFSETS = np.cumsum([0, *_SIZES[:-1]])


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that are found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    key = w[:-2] * len(ids) + w[1:-1]
    if len(ids) ** 3 >= 2**62:
        key = np.unique(key, return_inverse=True)[1]
    _, which, counts = np.unique(key * len(ids) + w[2:], return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= again
    return int(covered.sum())


class Lines:
    """The texts' lines that hold a word: the features of each, and each text's base counts."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        ends = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
        doc_ends = np.cumsum([len(p) + 1 for p in parts])
        of = np.searchsorted(doc_ends, starts, side="right")
        space = _CLASSES["space"][data]
        first = ~space
        first[1:] &= space[:-1]
        each = lambda flags: np.add.reduceat(flags, starts, dtype=np.int64)
        words = each(first)
        counts = {k: each(_CLASSES[k][data]) for k in ("space", "point", *_SHARES)}
        chars = np.maximum(ends - starts - counts["space"] + 1, 0)  # a line's own end is a space
        dup = np.zeros(len(starts), bool)
        self.repeats = np.zeros(len(parts), np.int64)
        at = 0
        for i, p in enumerate(parts):
            self.repeats[i] = repeated_words(p.split())
            seen: set[bytes] = set()
            for line in p.split(b"\n"):
                dup[at] = line in seen
                seen.add(line)
                at += 1
        total = lambda x: np.bincount(of, x, len(parts)).astype(np.int64)
        self.docs = len(parts)
        points = counts["point"] - counts["space"]  # every space is one code point
        self.words, self.chars, self.symbols = total(words), total(points), total(counts["symbol"])
        full = words > 0
        self.dups = total(dup & full)
        safe = np.maximum(chars, 1)
        solid = np.where(space, 0, np.arange(len(data)))
        np.maximum.accumulate(solid, out=solid)
        last = data[solid[ends]]
        columns = [np.searchsorted(_SHARE_BINS, counts[k] / safe) for k in _SHARES]
        columns += [np.searchsorted(_COUNT_BINS, words), np.searchsorted(_LENGTH_BINS, chars / np.maximum(words, 1))]
        columns += [dup.astype(np.int64), np.isin(last, list(b".!?")).astype(np.int64)]
        self.features = (np.stack(columns, 1) + _OFFSETS)[full]
        self.line_words, self.of = words[full], of[full]
        self.lengths = np.bincount(self.of, minlength=len(parts))


@dataclass
class Field:
    """Weights of the features, the first line's and the transitions', for labels 0 boilerplate and 1 content."""

    features: np.ndarray
    start: np.ndarray
    moves: np.ndarray

    @staticmethod
    def all_content() -> Field:
        return Field(np.zeros((N_FEATURES, 2)), np.array([0.0, 1.0]), np.zeros((2, 2)))

    def decode(self, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Viterbi: the label of each line; lines of a sequence stand together, sequences in the order of lengths."""
        score = self.features[features].sum(1)
        order = np.argsort(-lengths, kind="stable")
        begin = (np.cumsum(lengths) - lengths)[order]
        sizes = lengths[order]
        back = np.zeros((len(score), 2), np.int8)
        best = np.zeros((len(sizes), 2))
        labels = np.zeros(len(score), np.int8)
        active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        for t, n in enumerate(active):
            at = begin[:n] + t
            if t == 0:
                best[:n] = self.start + score[at]
                continue
            moved = best[:n, :, None] + self.moves
            back[at] = moved.argmax(1)
            best[:n] = moved.max(1) + score[at]
        here = best.argmax(1)
        for t in range(len(active) - 1, -1, -1):
            n = active[t]
            at = begin[:n] + t
            labels[at] = here[:n]
            here[:n] = np.where(t > 0, back[at, here[:n]], here[:n])
        return labels


@dataclass
class Sequences:
    """Lines of documents in pieces: features of each line, begin and length of each piece (longest first), weight of each line's piece."""

    features: np.ndarray
    begin: np.ndarray
    lengths: np.ndarray
    line_weight: np.ndarray

    def marginals(self, params: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of each line's labels, of the labels of each line and the one before it, log of each line's piece's sum), by forward-backward."""
        active = np.searchsorted(-self.lengths, -np.arange(1, self.lengths[0] + 1), side="right")
        score = params[0][self.features].sum(1)
        forward, backward = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        for t, n in enumerate(active):
            at = self.begin[:n] + t
            forward[at] = score[at] + (params[1] if t == 0 else np.logaddexp.reduce(forward[at - 1][:, :, None] + params[2], axis=1))
        for t in range(len(active) - 2, -1, -1):
            at = self.begin[: active[t + 1]] + t
            backward[at] = np.logaddexp.reduce(params[2] + (score[at + 1] + backward[at + 1])[:, None, :], axis=2)
        whole = np.zeros(len(score))
        for b, n, z in zip(self.begin, self.lengths, np.logaddexp.reduce(forward[self.begin] + backward[self.begin], axis=1), strict=True):
            whole[b : b + n] = z
        inner = self.inner
        pair = np.exp(forward[inner - 1][:, :, None] + params[2] + (score[inner] + backward[inner])[:, None, :] - whole[inner][:, None, None])
        return np.exp(forward + backward - whole[:, None]), pair, whole

    @property
    def inner(self) -> np.ndarray:
        """The lines that have one before them in their piece."""
        return np.setdiff1d(np.arange(len(self.features)), self.begin)

    def counts(self, share: np.ndarray, pair: np.ndarray) -> list[np.ndarray]:
        """Weighted sums of the features by label, of the first labels and of the moves."""
        weighted = share * self.line_weight[:, None]
        by_label = [np.bincount(self.features.ravel(), np.repeat(weighted[:, c], self.features.shape[1]), N_FEATURES) for c in (0, 1)]
        return [np.stack(by_label, 1), weighted[self.begin].sum(0), (pair * self.line_weight[self.inner][:, None, None]).sum(0)]

    def observed(self, y: np.ndarray) -> list[np.ndarray]:
        share = np.stack([y == 0, y == 1], 1).astype(float)
        return self.counts(share, share[self.inner - 1][:, :, None] * share[self.inner][:, None, :])

    def gradient(self, params: list[np.ndarray], y: np.ndarray, ridge: float) -> tuple[float, list[np.ndarray]]:
        """(weighted log-likelihood of the line labels y, its gradient)."""
        share, pair, whole = self.marginals(params)
        seen, expected = self.observed(y), self.counts(share, pair)
        value = sum((p * s).sum() for p, s in zip(params, seen, strict=True)) - (whole * self.line_weight)[self.begin].sum()
        value -= ridge / 2 * sum((p**2).sum() for p in params)
        return value, [s - e - ridge * p for p, s, e in zip(params, seen, expected, strict=True)]


def ascend(x: Sequences, y: np.ndarray, params: list[np.ndarray], steps: int = STEPS, rate: float = 0.15, ridge: float = 1e-3) -> None:
    """Adam, in place."""
    one, two = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        for k, g in enumerate(x.gradient(params, y, ridge)[1]):
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            params[k] += rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)


def held_to(margin: np.ndarray, words: np.ndarray, good: bool) -> np.ndarray:
    """Labels of a document's lines: content where the margin is positive, but for the nearest lines that its label claims."""
    y = margin > 0
    total = words.sum()
    if good:
        order = np.argsort(-margin, kind="stable")
        y[order[np.cumsum(words[order]) - words[order] < GOOD_CONTENT * total]] = True
    else:
        order = np.argsort(margin, kind="stable")
        y[order[np.cumsum(words[order]) - words[order] < (1 - BAD_CONTENT) * total]] = False
    return y.astype(np.int64)


def fit(sequences: list[np.ndarray], words: list[np.ndarray], labels: list[int], sweeps: int = SWEEPS, steps: int = STEPS) -> Field:
    """The field of documents (the features and the words of their lines) with a label each; see the module."""
    if len(set(labels)) < 2:
        return Field.all_content()
    sizes = np.array([len(s) for s in sequences])
    ends = np.cumsum(sizes)
    spans = [slice(e - n, e) for e, n in zip(ends, sizes, strict=True)]
    features, good = np.concatenate(sequences), np.array(labels) == 1
    # each kind of document weighs the same
    weight = np.where(good, 0.5 / good.sum(), 0.5 / (~good).sum())
    begin = np.concatenate([np.arange(e - n, e, TRAIN_LINES) for e, n in zip(ends, sizes, strict=True)])
    lengths = np.minimum(TRAIN_LINES, ends[np.searchsorted(ends, begin, side="right")] - begin)
    order = np.argsort(-lengths, kind="stable")
    x = Sequences(features, begin[order], lengths[order], np.repeat(weight, sizes))
    # the first guess: how much more often each feature stands in lines of good documents than of bad ones
    often = [np.bincount(features.ravel(), np.repeat(x.line_weight * (np.repeat(good, sizes) == kind), features.shape[1]), N_FEATURES) for kind in (False, True)]
    often = [(o / max(o.sum(), 1e-12)) + 1e-4 for o in often]
    margin = np.log(often[1] / often[0])[features].sum(1)
    params = [np.zeros((N_FEATURES, 2)), np.zeros(2), np.zeros((2, 2))]
    for _ in range(sweeps):
        y = np.concatenate([held_to(margin[s], w, g) for s, w, g in zip(spans, words, good, strict=True)])
        ascend(x, y, params, steps)
        share = x.marginals(params)[0]
        margin = np.log((share[:, 1] + 1e-12) / (share[:, 0] + 1e-12))
    return Field(*params)


def stretches(n: int, most: int = SAMPLE_LINES) -> np.ndarray:
    """The lines of n that training sees: all, or stretches of TRAIN_LINES spread over the whole."""
    if n <= most:
        return np.arange(n)
    parts = most // TRAIN_LINES
    return np.concatenate([(n - TRAIN_LINES) * i // (parts - 1) + np.arange(TRAIN_LINES) for i in range(parts)])


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """The field from at most sample_docs labelled documents; their lines' features, not their texts, come to the driver."""
    own = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("label"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    width = len(_SIZES)

    @F.pandas_udf("array<int>")
    def features(texts: pd.Series) -> pd.Series:
        lines = Lines(list(texts))
        rows = np.column_stack([lines.features, lines.line_words])
        ends = np.cumsum(lines.lengths)
        return pd.Series([rows[e - n : e][stretches(n)].ravel().astype(np.int32) for e, n in zip(ends, lines.lengths, strict=True)])

    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = texts.select("doc_id", "label", features("text").alias("f")).collect()
    rows = sorted((r for r in rows if r.f), key=lambda r: r.doc_id)
    lines = [np.array(r.f, np.int64).reshape(-1, width + 1) for r in rows]
    return fit([x[:, :width] for x in lines], [x[:, width] for x in lines], [int(r.label) for r in rows])


def judged(field: Field, min_words: int = MIN_WORDS, min_content: float = MIN_CONTENT):
    """Column function: a text's counts and verdict (SCHEMA)."""

    @F.pandas_udf(SCHEMA)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            x = Lines(list(texts))
            content = np.bincount(x.of, x.line_words * field.decode(x.features, x.lengths), x.docs).astype(np.int64)
            failed = (x.words < min_words) | (100 * x.repeats > 50 * x.words)
            yield pd.DataFrame({
                "n_words": x.words, "word_chars": x.chars, "n_symbols": x.symbols, "n_dup_lines": x.dups, "n_repeat_words": x.repeats,
                "n_lines": x.lengths.astype(np.int64), "content_words": content, "base_failed": failed, "kept": ~failed & (content >= min_content * x.words),
            })

    return judge


def filtered(docs: DataFrame, field: Field, **options) -> DataFrame:
    """The rows of docs that are kept, in its columns."""
    return docs.where(judged(field, **options)(docs["text"])["kept"])


def op9_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.select("doc_id", judged(field)(docs["text"]).alias("q")).select("doc_id", "q.*")
