"""The score store, guards that refuse, and what they leave behind."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import guards as G
from tidemark.sources.score_store import ScoreStore, weights_version

DAY = dt.date(2001, 3, 30)


def scores(spark, rows):
    full = [(i, dt.date.fromisoformat(d), m, c, "STRONG" if c >= 60 else "WATCH", c, c, c, c, c, 90.0) for i, d, m, c in rows]
    return spark.createDataFrame(full, "id long, d date, mode string, composite double, rating string, fundamental double, valuation double, technical double, momentum double, whale double, confidence double")


def test_versions_tell_settings_apart():
    a = weights_version({"w": (1, 2), "x": {"b": 1, "a": 2}})
    assert a == weights_version({"x": {"a": 2, "b": 1}, "w": (1, 2)}) != weights_version({"w": (1, 3), "x": {"b": 1, "a": 2}}) and len(a) == 10


def test_store_replaces_partitions_and_reads_them_pruned(spark, tmp_path):
    store = ScoreStore(spark, str(tmp_path / "scores"))
    assert store.latest_scores("balanced").count() == 0 and store.as_of_dates("balanced").count() == 0
    rows = [(1, "2001-01-31", "balanced", 50.0), (2, "2001-01-31", "balanced", 70.0), (1, "2001-02-28", "balanced", 65.0), (3, "2001-02-28", "balanced", 40.0), (1, "2001-02-28", "aggressive", 10.0)]
    store.write(scores(spark, rows), {"balanced": "v1", "aggressive": "a1"})
    assert [(r.id, r.d.isoformat(), r.composite) for r in store.latest_scores("balanced").collect()] == [(2, "2001-01-31", 70.0), (1, "2001-02-28", 65.0), (3, "2001-02-28", 40.0)]
    # February of v1 again, without id 3: its partition is replaced, January and the other mode stand
    store.write(scores(spark, [(1, "2001-02-28", "balanced", 66.0)]), {"balanced": "v1"})
    assert {(r.id, r.composite) for r in store.latest_scores("balanced").collect()} == {(2, 70.0), (1, 66.0)}
    assert store.of("aggressive").count() == 1
    # a new version of January stands beside the old one
    store.write(scores(spark, [(1, "2001-01-31", "balanced", 80.0)]), {"balanced": "v2"})
    assert {(r.id, r.composite) for r in store.screen("balanced", "2001-01-31").collect()} == {(1, 80.0), (2, 70.0)}
    history = store.score_history(1, "balanced").collect()
    assert [(r.d.isoformat(), r.composite, r.version) for r in history] == [("2001-01-31", 50.0, "v1"), ("2001-02-28", 66.0, "v1")]
    assert [r.composite for r in store.score_history(1, "balanced", same_version=False).collect()] == [80.0, 66.0]
    assert [r.d.isoformat() for r in store.as_of_dates("balanced").collect()] == ["2001-01-31", "2001-02-28"]
    top = store.screen("balanced", "2001-01-31", least=75.0, ratings=["STRONG"]).first()
    assert (top.id, top.pct_rank) == (1, 100.0)
    assert tuple(store.universe("balanced").first()) == (2, dt.date(2001, 2, 28), "v1")
    with pytest.raises(ValueError, match="no version"):
        store.write(scores(spark, [(1, "2001-02-28", "other", 1.0)]), {"balanced": "v1"})
    plan = store.screen("balanced", "2001-01-31")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "mode" in filters and "month" in filters
    assert "version" in store.score_history(1, "balanced")._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def pool(spark, n=40, day=DAY, value=lambda i: 1.0, growth=lambda i: 2.0, volume=lambda i: 10):
    return spark.createDataFrame([(i, day, value(i), growth(i), volume(i)) for i in range(n)], "id long, d date, value double, growth double, volume long").repartition(3)


def all_guards():
    return [G.fresh("d", DAY), G.enough(30), G.leg_present("value"), G.legs_covered(["value", "growth"]), G.complete("volume"), G.not_stale("d", DAY + dt.timedelta(9))]


BROKEN = {
    "fresh": {"day": dt.date(2001, 3, 29)}, "enough": {"n": 29}, "leg": {"value": lambda i: None}, "legs": {"growth": lambda i: None if i < 3 else 1.0}, "complete": {"volume": lambda i: 0 if i < 9 else 1},
}


@pytest.mark.parametrize("name", BROKEN)
def test_a_broken_guard_publishes_nothing(spark, tmp_path, name):
    path = str(tmp_path / "pool")
    G.published(pool(spark), path, all_guards())
    with pytest.raises(G.GuardError) as refused:
        G.published(pool(spark, **BROKEN[name]), path, all_guards())
    assert name in refused.value.broken
    assert spark.read.parquet(path).where(F.col("volume") == 10).count() == 40 and [x.name for x in tmp_path.iterdir()] == ["pool"]


def test_whole_rows_are_published_with_warnings(spark, tmp_path):
    path = str(tmp_path / "pool")
    assert list(G.published(pool(spark), path, all_guards())) == ["stale"]
    assert G.published(pool(spark, 50), path, all_guards()[:5]) == {} and spark.read.parquet(path).count() == 50


def test_a_fifth_of_the_value_leg_may_be_missing(spark, tmp_path):
    guard = [G.leg_present("value")]
    assert G.published(pool(spark, value=lambda i: None if i < 8 else 1.0), str(tmp_path / "a"), guard) == {}
    with pytest.raises(G.GuardError, match="22.5 %"):
        G.published(pool(spark, value=lambda i: None if i < 9 else 1.0), str(tmp_path / "b"), guard)


def test_command_line_builds_and_screens(spark, tmp_path, capsys):
    from tidemark.__main__ import main, versions

    where = str(tmp_path / "scores")
    main(["build", "--store", where, "--tables", "/root/testdata/sf0.001", "--since", "2001-06-15", "--mode", "balanced"], spark)
    store = ScoreStore(spark, where)
    days = [r.d for r in store.as_of_dates("balanced").collect()]
    assert days and min(days) >= dt.date(2001, 6, 1) and store.of("aggressive").count() == 0
    assert {r.version for r in store.table.select("version").distinct().collect()} == {versions()["balanced"]}
    main(["screen", "--store", where, "--day", days[-1].isoformat(), "--least", "1", "--top", "5"], spark)
    main(["history", "--store", where, "--id", str(store.latest_scores("balanced").first().id), "--top", "3"], spark)
    assert "pct_rank" in (shown := capsys.readouterr().out) and shown.count("version") == 2 and len(set(versions().values())) == 3
