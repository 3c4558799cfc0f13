"""Command line of the score store: python -m tidemark build|latest|screen|history|dates --store PATH ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores as R
from tidemark.plans.base import Panels
from tidemark.plans.snapshot import rated
from tidemark.sources.score_store import ScoreStore, weights_version


def versions() -> dict[str, str]:
    """The version of each mode: its weights, gates and what else decides a score."""
    return {m: weights_version({"weights": w, "gates": R.PROFILES[m], "regimes": R.REGIME_FACTORS, "bear": R.BEAR_GATES, "valuation": "industry"}) for m, w in R.MODES.items()}


def build(spark: SparkSession, tables: str, store: ScoreStore, since: str | None = None, modes: list[str] | None = None) -> None:
    """Scores every entity, day and mode of the tables (of the days from `since` on) and writes them to the store."""
    rows = rated(Panels(spark, tables)).where(F.col("mode").isin(modes or list(R.MODES)))
    if since:
        rows = rows.where(F.col("d") >= F.trunc(F.to_date(F.lit(since)), "month"))  # whole months, as they are replaced
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in ("rev_growth", "ni", "big")), F.lit(0))
    store.write(rows.select("id", "d", "mode", "composite", "rating", "fundamental", F.col("val").alias("valuation"), "technical", "momentum", "whale", (100 - 8.0 * missing).alias("confidence")), versions())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    of = parser.add_subparsers(dest="what", required=True)
    for what in ("build", "latest", "screen", "history", "dates"):
        sub = of.add_parser(what)
        sub.add_argument("--store", required=True)
        sub.add_argument("--mode", choices=list(R.MODES), default=None if what == "build" else "balanced")
        if what == "build":
            sub.add_argument("--tables", required=True)
            sub.add_argument("--since")
        if what == "screen":
            sub.add_argument("--day")
            sub.add_argument("--least", type=float)
            sub.add_argument("--rating", action="append")
            sub.add_argument("--confidence", type=float)
        if what == "history":
            sub.add_argument("--id", type=int, required=True)
            sub.add_argument("--all-versions", action="store_true")
        if what in ("latest", "screen", "history"):
            sub.add_argument("--top", type=int, default=30)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tidemark").getOrCreate()
    store = ScoreStore(spark, a.store)
    if a.what == "build":
        build(spark, a.tables, store, a.since, [a.mode] if a.mode else None)
    elif a.what == "latest":
        store.latest_scores(a.mode).show(a.top, False)
    elif a.what == "screen":
        store.screen(a.mode, a.day, a.least, a.rating, a.confidence, a.top).show(a.top, False)
    elif a.what == "history":
        store.score_history(a.id, a.mode, a.top, not a.all_versions).show(a.top, False)
    else:
        store.as_of_dates(a.mode).show(10_000, False)


if __name__ == "__main__":
    main()
