"""Keyed traversals of many rows: what is shuffled, hubs, nulls and ties."""

from __future__ import annotations

import random
import re
from functools import partial

import pytest
from conftest import rows_of
from test_graph_queries import LINE, hops

from sparkloom.functions import skew
from sparkloom.operators import graph
from sparkloom.plans import graph as plans


@pytest.fixture
def many(monkeypatch):
    """Any frontier counts as one of many rows."""
    monkeypatch.setattr(skew, "FEW", 0)


def written_rows(spark):
    """Rows that stages have written to shuffles so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._gateway.new_array(context._gateway.jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(i) for i in range(stages.size()))}


def test_sets_of_near_nodes_are_aggregated_before_they_are_shuffled(spark, make, many):
    rng = random.Random(5)
    groups, of, each = 8, 60, 30
    pairs = {(g * of + a, g * of + b) for g in range(groups) for a in range(of) for b in rng.sample(range(of), each)}
    edges, seeds = make(sorted(pairs), "src int, dst int"), make([(i, i) for i in range(0, groups * of, 10)], "source int, id int")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(groups)}
    before = {key: spark.conf.get(key) for key in conf}
    try:
        for key, value in conf.items():
            spark.conf.set(key, value)
        known = written_rows(spark)
        found = graph.expand(edges, seeds, 4, ("source",), paths=False)
        shuffled = sum(n for stage, n in written_rows(spark).items() if stage not in known)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert rows_of(found) == sorted(((s, k, n) for s in range(0, groups * of, 10) for k, n in hops(pairs, [s], 4).items()), key=repr)
    assert shuffled < 3 * len(pairs)


def test_hubs_and_nulls_of_many_rows(spark, make, many, monkeypatch):
    monkeypatch.setattr(graph, "hubs_of", partial(skew.hubs_of, block=50))
    rng = random.Random(7)
    pairs = {(rng.randrange(600), rng.randrange(600)) for _ in range(1500)} | {(rng.randrange(3), rng.randrange(600)) for _ in range(600)}
    edges = make([*sorted(pairs), (None, 4), (9, None)], "src int, dst int")
    seeds = make([*((i, i) for i in range(300)), (300, None)], "source int, id int")
    expected = [(s, k, n) for s in range(300) for k, n in hops(pairs | {(9, None)}, [s], 4).items()]
    assert any(k is None for _, k, _ in expected)
    assert rows_of(graph.expand(edges, seeds, 4, ("source",), paths=False)) == sorted([*expected, (300, None, 0)], key=repr)


def test_paths_sort_only_ends_of_lines(spark, make, monkeypatch, tmp_path):
    rng = random.Random(9)
    lines = [(o, rng.randint(1, 2), rng.randint(1, 4) * 50, rng.randint(1, 3), float(rng.randint(1, 50)), 1.0, 0.0, 0.0, rng.choice("ARN"), "O", rng.choice("xyz")) for o in range(200) for _ in range(5)]
    make(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    make([(i,) for i in range(50, 201, 50)], "p_partkey bigint").write.parquet(str(tmp_path / "part.parquet"))
    seen, plain = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: seen.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    pairs = {tuple(r) for r in plans.part_edges(spark, str(tmp_path)).select("src", "dst").collect()}
    found = rows_of(plans.QUERIES["whole_shortest_path_len"](spark, str(tmp_path)))
    assert found == sorted(((s, k, n) for s in (100, 200) for k, n in hops(pairs, [s], 6).items()), key=repr)
    assert any("l_linenumber" in plan for plan in seen) and not any(re.search("l_(shipdate|tax|suppkey)", plan) for plan in seen)


def test_hops_of_few_each_are_not_listed(spark, make, monkeypatch):
    monkeypatch.setattr(graph, "near_join", None)
    edges, seeds = make([(1, 2), (2, 3), (5, 3)], "src int, dst int"), make([(1, 1), (5, 5)], "source int, id int")
    assert rows_of(graph.expand(edges, seeds, 4, ("source",), paths=False)) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (5, 3, 1), (5, 5, 0)]
