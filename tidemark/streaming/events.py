"""Windows, sessions, first-seen and confirmed state over a stream of events; each works on batch frames as well."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "2 hours"


def timed(events: DataFrame, late: str = LATE) -> DataFrame:
    """events with `at`, a timestamp with a watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)


def windowed(events: DataFrame, size: str, slide: str | None = None) -> DataFrame:
    """start, event_type, n, total (cents) of tumbling or sliding windows."""
    w = F.window("at", size, slide) if slide else F.window("at", size)
    rows = timed(events).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, n of runs of a user's events with less than `gap` between them."""
    rows = timed(events).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), "n")


def first_of_each(events: DataFrame, keys: list[str]) -> DataFrame:
    """events without those whose keys were seen within the watermark."""
    return timed(events).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def upserted_to(path: str, keys: list[str]):
    """A foreachBatch function that appends the rows whose keys the Parquet table at `path` lacks."""

    def write(batch: DataFrame, _: int) -> None:
        fresh = batch.dropDuplicates(keys)
        try:
            old = batch.sparkSession.read.parquet(path).select(*keys)
        except Exception as e:  # the first batch: no table yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            fresh = fresh.join(old, keys, "left_anti")
        fresh.write.mode("append").parquet(path)

    return write


def confirmed_states(rows: DataFrame, confirm: int = 3) -> DataFrame:
    """user_id, day, up, state of a stream (user_id, day, up): the state flips after `confirm` equal observations in a row."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, last, run = state.get if state.exists else (None, None, 0)
        out = []
        for f in frames:
            for day, up in f.sort_values("day")[["day", "up"]].itertuples(index=False):
                run = run + 1 if up == last else 1
                last = bool(up)
                now = last if now is None or run >= confirm else now
                out.append((key[0], day, last, now))
        state.update((now, last, run))
        yield pd.DataFrame(out, columns=["user_id", "day", "up", "state"])

    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, day date, up boolean, state boolean", "now boolean, last boolean, run int", "append", "NoTimeout")
