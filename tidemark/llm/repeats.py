"""Which places of a corpus bear a name that another place bears, too."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grams import flat, mixed, pieces

#: Words that a task holds at a time.
UNIT_WORDS = 1 << 19
#: Bytes of text whose names stand in one bucket, which a task holds at a time.
BUCKET_BYTES = 48 << 20
#: Names (one array or several, that are equal together), keys and places.
Named = tuple[list[np.ndarray], np.ndarray, np.ndarray]


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(df: DataFrame, text_bytes: int) -> int:
    """Buckets that packed arrays are dealt to: one a partition of a shuffle at least, more where the text needs more."""
    return max(partitions(df), -(-text_bytes // BUCKET_BYTES))


def by_bucket(rows: DataFrame, n: int) -> DataFrame:
    """rows dealt by bucket; a partition with several has them one after another. A negative bucket b goes where -1 - b does."""
    at = F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))
    parts = min(n, partitions(rows))
    dealt = rows.repartitionById(parts, (at % parts).cast("int"))
    return dealt if n == parts else dealt.sortWithinPartitions(at)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each bucket, of rows that stand in the order of buckets."""
    held, now = [], None
    for b in batches:
        at = b.column("bucket").to_numpy()
        at = np.where(at < 0, -1 - at, at)
        for start, end in pairwise([0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]):
            if end > start:
                if held and at[start] != now:
                    yield held
                    held = []
                now = at[start]
                held.append(b.slice(start, end - start))
    if held:
        yield held


def in_parts(bucket: np.ndarray, n: int, *arrays: np.ndarray) -> Iterator[tuple]:
    """(bucket, its part of each array as bytes)."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    first = np.flatnonzero(_starts(bucket))
    for i, j in pairwise([*first.tolist(), len(bucket)]):
        yield int(bucket[i]), *[a[i:j].tobytes() for a in arrays]


def as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_parts(batches: Iterator[pa.RecordBatch], kinds: dict[str, type]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {k: [] for k in kinds}
    for b in batches:
        for k, kind in kinds.items():
            parts[k] += [np.frombuffer(x.as_buffer(), kind) for x in b.column(k)]
    return {k: np.concatenate([*v, np.zeros(0, kinds[k])]) for k, v in parts.items()}


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where any of the columns differs from the row before."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def repeated(df: DataFrame, named: Callable[[list[pa.RecordBatch]], Named], buckets: int, width: int = 1) -> DataFrame:
    """(key, places): of each key the sorted places, as packed 32-bit numbers, whose name is borne by another (key, place).

    named: names (`width` arrays of 64 bits), keys (64 bits, not 0) and places (32 bits) of a unit of df's rows; df has a
    column w, an array of word hashes. Names travel as packed arrays, dealt out by hash. A name that a unit bears several
    times is counted there and travels once for all of them, so that a task gets no more of any name than there are units.
    """
    columns = [f"names{i}" for i in range(width)]
    which = lambda x: (mixed(x) % np.uint64(buckets)).astype(np.int32)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in pieces(batches, UNIT_WORDS):
            held.append(b)
            n += len(flat(b.column("w"))[0])
            if n >= UNIT_WORDS:
                yield from unit(named(held))
                held, n = [], 0
        if held:
            yield from unit(named(held))

    def unit(found: Named) -> Iterator[pa.RecordBatch]:
        names, keys, places = found
        order = np.lexsort(names[::-1])
        names, keys, places = [x[order] for x in names], keys[order], places[order].astype(np.uint32)
        new = _starts(*names)
        first = np.flatnonzero(new)
        # equal texts of one unit bear the same names at the same places: they are one text
        group = np.cumsum(new) - 1
        other = (keys != keys[first][group]) | (places != places[first][group])
        many = np.zeros(len(first), bool)
        many[group[other]] = True
        known = many[group]
        rows = []
        if len(first):
            n, k, p = [x[first] for x in names], np.where(many, np.uint64(0), keys[first]), places[first]
            rows += list(in_parts(which(n[0]), buckets, *n, k, p))
        if known.any():
            k, p = keys[known], places[known]
            rows += [(-1 - b, *[b""] * width, *x) for b, *x in in_parts(which(k), buckets, k, p)]
        if rows:
            yield as_batch(rows, ["bucket", *columns, "keys", "places"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in one_by_one(batches):
            for b in rows:
                passed = b.filter(pc.less(b.column("bucket"), 0))
                if passed.num_rows:
                    yield pa.RecordBatch.from_arrays([pc.subtract(pa.scalar(-1, pa.int32()), passed.column("bucket")), passed.column("keys"), passed.column("places")], ["bucket", "keys", "places"])
            met = as_parts(read_parts((b.filter(pc.greater_equal(b.column("bucket"), 0)) for b in rows), {c: np.uint64 for c in columns} | {"keys": np.uint64, "places": np.uint32}))
            if met:
                yield as_batch(met, ["bucket", "keys", "places"])

    def as_parts(x: dict[str, np.ndarray]) -> list[tuple]:
        """The places, dealt by key, whose name another place bears."""
        names, keys, places = [x[c] for c in columns], x["keys"], x["places"]
        order = np.lexsort((places, keys, *names[::-1]))
        names, keys, places = [n[order] for n in names], keys[order], places[order]
        distinct = _starts(*names, keys, places) | (keys == 0)
        names, keys, places = [n[distinct] for n in names], keys[distinct], places[distinct]
        if not len(keys):
            return []
        first = np.flatnonzero(_starts(*names))
        count = np.diff(np.append(first, len(keys)))
        many = np.repeat((count > 1) | (keys[first] == 0), count) & (keys != 0)
        keys, places = keys[many], places[many]
        order = np.lexsort((places, keys))
        return list(in_parts(which(keys[order]), buckets, keys[order], places[order])) if len(keys) else []

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in one_by_one(batches):
            x = read_parts(rows, {"keys": np.uint64, "places": np.uint32})
            order = np.lexsort((x["places"], x["keys"]))
            keys, places = x["keys"][order], x["places"][order]
            distinct = _starts(keys, places)
            keys, places = keys[distinct], places[distinct]
            first = np.flatnonzero(_starts(keys)) if len(keys) else np.zeros(0, np.int64)
            cuts = np.append(first, len(keys))
            for i in range(0, len(first), 1000):
                part = range(i, min(i + 1000, len(first)))
                yield pa.RecordBatch.from_arrays([pa.array(keys[first[i : i + 1000]].view(np.int64)), pa.array([places[cuts[j] : cuts[j + 1]].tobytes() for j in part], pa.binary())], ["key", "places"])

    packed = ", ".join(f"{c} binary" for c in (*columns, "keys", "places"))
    dealt = by_bucket(df.mapInArrow(deal, f"bucket int, {packed}"), buckets)
    return by_bucket(dealt.mapInArrow(meet, "bucket int, keys binary, places binary"), buckets).mapInArrow(gather, "key long, places binary")
