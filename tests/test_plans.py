"""How Spark is told to run what small tables alone wouldn't show."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import folds, graph, intervals
from cairn.plans import catalogue, forks
from tests.oracle import assert_same

SMALL = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["chain_intersection", "dag_prune", "fork_length", "fork_valid", "hash_list_diff", "reorg_replay"])
def test_no_chain_is_broadcast(spark, monkeypatch, name):
    """Joins of two sets of blocks don't go by the size of their files, a byte a block."""
    plans, real = [], forks.stored
    monkeypatch.setattr(forks, "stored", lambda df, to: plans.append(planned(df)) or real(df, to))
    plans.append(planned(catalogue.QUERIES[name](spark, SMALL)))
    assert any(re.search(r"SortMergeJoin .*LeftAnti", p) for p in plans)
    assert not any(re.search(r"BroadcastHashJoin \[id.*LeftAnti", p) for p in plans)


def test_fold_after_a_join(spark):
    """A join that turns out to be a broadcast doesn't deal a key's rows out to several tasks."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "2k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(0, 90_000, 1, 8).select((F.col("id") % 3).alias("k"), "id")
        joined = rows.join(rows.groupBy("k").agg(F.max("id").alias("m")), "k")
        counted = folds.folded(joined, ["k"], ["id"], "k long, n long", lambda: 0, lambda n, _: (n + 1, []), lambda n: [(n,)])
        assert sorted(map(tuple, counted.collect())) == [(0, 30_000), (1, 30_000), (2, 30_000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("made", [intervals.merge, lambda df: intervals.subtract(df, df.where("start > 0")), lambda df: intervals.gaps_within(df, 5, 50)])
def test_sweeps_are_not_planned_over_and_over(spark, made):
    """What a sweep found in its cells is stored; only a row per cell is gone over again."""
    df = spark.createDataFrame([("a", 0, 3), ("a", 2, 5), ("b", 7, 9)], "set_id string, start long, end long")
    assert planned(made(df)).count("Exchange") <= 24


@pytest.mark.parametrize("name", ["peer_footprint_plan", "task_dedup", "task_take"])
def test_chunks_are_not_made_distinct_first(spark, name):
    """A chunk is found again by its footprint's bits or its least peer, not in a set of all chunks of all peers."""
    assert not re.search(r"HashAggregate\(keys=\[\w+#\w+, chunk#\w+\], functions=\[\]", planned(catalogue.QUERIES[name](spark, SMALL)))


def test_only_the_last_operation_on_an_interval_is_joined(spark, monkeypatch):
    joined, real = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda a, b, keys=(): joined.append(b.count()) or real(a, b, keys))
    ops = spark.range(100).select(F.lit("k").alias("k"), F.lit(2).alias("start"), F.lit(9).alias("end"), F.col("id").alias("seq"), (F.col("id") % 2 == 1).alias("adds"))
    assert [tuple(r) for r in intervals.replayed(ops, ["k"], "seq", "adds").collect()] == [("k", 2, 9)]
    assert joined == [1]


@pytest.mark.parametrize("name", ["chain_dump", "dag_prune", "fork_length", "fork_valid", "hash_list_diff", "reorg_replay"])
def test_walks_broadcast_no_nodes(spark, monkeypatch, name):
    """Nor do those within the walks: all blocks with the tops of their cells, tops with tops, and transactions by block."""
    plans = []
    for module in (forks, graph):
        monkeypatch.setattr(module, "stored", lambda df, to, real=module.stored: plans.append(planned(df)) or real(df, to))
    plans.append(planned(catalogue.QUERIES[name](spark, SMALL)))
    assert len(plans) > 5
    assert not any("BroadcastHashJoin" in p for p in plans)


def test_neighbours_are_dealt_out_by_number(spark, monkeypatch):
    """Neither a solution's blocks nor as many as fit into a partition by their bytes are one task's, and no side of the overlaps is broadcast."""
    monkeypatch.setattr(forks, "A_PART", 100)
    plan = planned(catalogue.QUERIES["solution_match"](spark, SMALL))
    assert re.search(r"hashpartitioning\(solution#\w+, _cell#\w+, 16\), REPARTITION_BY_NUM", plan)
    assert "BroadcastHashJoin" not in plan


def test_neighbours_beyond_cells(spark, monkeypatch):
    """Neighbours lie in other cells, too."""
    monkeypatch.setattr(forks, "A_PART", 100)
    monkeypatch.setattr(forks, "SOLUTIONS_CELL", 4)
    assert_same(catalogue.QUERIES["solution_match"](spark, SMALL), catalogue.ORACLES["solution_match"], SMALL)
