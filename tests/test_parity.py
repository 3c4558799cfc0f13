"""Queries give the rows of their DuckDB SQL on the smallest tables."""

import os

import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
NAMES = (
    "bars_build", "asof_join_tol", "yoy_nearest", "upsert_keep_last", "outer_ffill", "t_plus_k", "macd", "rsi14", "expanding_pct", "weekly_ma", "vol_profile_poc",
    "industry_rank", "rank_ic", "decile_excess", "c2_slice", "funnel_l2", "list_streak", "rev_momentum", "fund_score", "rating", "debounce", "regime_raw", "exit_trailing", "ranked_curve", "event_sessions",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, str)):
        return v
    if hasattr(v, "isoformat"):
        return str(v)
    return float(v)


@pytest.mark.parametrize("name", NAMES)
def test_parity(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    want = duck.sql(registry.ORACLE[name])
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_oracle_has_its_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)
