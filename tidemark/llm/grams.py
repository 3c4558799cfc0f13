"""Word hashes and their runs as arrays, for operators that work on all word n-grams of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import lower_ascii, words_of

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def word_hashes(text: Column, lower: bool = False) -> Column:
    """Array of the 64-bit hashes of a text's words."""
    return F.transform(words_of(lower_ascii(text) if lower else text), lambda w: F.xxhash64(w))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def flat(column: pa.ListArray | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(the values of all lists, the number of each list's values) of a column of arrays of longs without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.int64)
    return values.view(np.uint64), np.diff(offsets).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], most: int, column: str = "w") -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most so many words (more only where one row has more)."""
    for b in batches:
        offsets = b.column(column).offsets.to_numpy()
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
            yield b.slice(at, end - at)
            at = end


def word_spans(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of the runs of bytes that are not space."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def words_at(data: np.ndarray, space: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
    """The words at these places, which hold all bytes that are not space."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~space])])


def runs(hashes: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n consecutive words of one document, index of its first word)."""
    ends = np.cumsum(lengths)
    last = np.repeat(ends, lengths) - n  # the last start in its document
    at = np.flatnonzero(np.arange(len(hashes)) <= last)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mixed(out + _ODD) ^ hashes[at + k] if n <= 8 else out * _ODD + mixed(hashes[at + k])
    return mixed(out), at
