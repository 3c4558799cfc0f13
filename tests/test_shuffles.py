"""What queries deal out: rows travel once where all that is made of them stays with their entity."""

import re

import pytest

from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"


def dealt(df) -> list[str]:
    """The exchanges that a query wrote, one entry each; broadcasts and exchanges read again are left out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [x.strip(" :+-") for x in plan.splitlines() if re.match(r"[ :+\-]*Exchange ", x)]


def by_entity(df) -> list[str]:
    return [x for x in dealt(df) if "hashpartitioning(id#" in x]


@pytest.mark.parametrize("name", ["exit_trailing", "exit_full", "pit_features"])
def test_items_are_dealt_out_once(spark, name):
    assert len(by_entity(registry.QUERIES[name](spark, FOLDER))) == 1


@pytest.mark.parametrize("name", ["mom_score", "whale_score", "pre_score", "data_gaps"])
def test_a_fact_that_is_not_read_costs_its_days_only(spark, name):
    assert len(by_entity(registry.QUERIES[name](spark, FOLDER))) <= 2


@pytest.mark.parametrize("name", ["valuation_history", "rating"])
def test_ranks_alone_come_back_from_their_days(spark, name):
    assert len(by_entity(registry.QUERIES[name](spark, FOLDER))) <= 3


def test_blocks_meet_without_copies(spark):
    # a block went along once for every other block
    df = registry.QUERIES["avg_pair_corr"](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "FlatMapGroupsInPandas" not in plan
