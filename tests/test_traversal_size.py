"""Joins and rows of traversals that grow: nothing of many rows is gathered by the driver, and keys go together."""

from __future__ import annotations

import random
import re

import pytest
from conftest import rows_of
from test_graph_queries import LINE, hops

from sparkloom.operators import graph
from sparkloom.plans import graph as plans
from sparkloom.plans import parts

MANY = 120_000


@pytest.fixture
def written(monkeypatch):
    """Plan and rows of every table that a traversal writes."""
    seen, plain = [], graph.stored

    def spy(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen.append((plan, found := plain(df)))
        return found

    monkeypatch.setattr(graph, "stored", spy)
    return seen


def chain(spark):
    """A step from each number to the next."""
    return spark.range(MANY + 10).selectExpr("id src", "id + 1 dst", "'calls' kind", "cast(null as string) resolved_by", "cast(null as string) synthesized_by")


def not_gathered(written):
    return not any(re.search(r"BroadcastHashJoin \[(src|id|root)#", plan) for plan, _ in written)


def test_forward_frontier_is_not_broadcast(spark, written):
    assert graph.expand(chain(spark), spark.range(MANY), 1, paths=False).count() == MANY + 1
    assert len(written) >= 3 and not_gathered(written)


def test_backward_frontier_is_not_broadcast(spark, written):
    reached = graph.expand(graph.backward_edges(chain(spark)), spark.range(10, MANY + 10), 1, paths=False)
    assert reached.count() == MANY + 1 and not_gathered(written)


def test_expansion_by_depth_of_many_sources(spark, make, written, tmp_path):
    spark.range(MANY * 100).filter("id % 100 = 0").selectExpr("id p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    line = "id div 2 l_orderkey, cast(id % 2 as int) l_linenumber, (id div 2) * 100 + id % 2 l_partkey, 1L l_suppkey, 1D l_quantity, 1D l_extendedprice, 0D l_discount, 0D l_tax, 'A' l_returnflag, 'O' l_linestatus, 'x' l_shipdate"
    spark.range(MANY * 2).selectExpr(*line.split(", ")).write.parquet(str(tmp_path / "lineitem.parquet"))
    shown = rows_of(parts.expansion_by_depth(spark, str(tmp_path)))
    assert sorted(shown, key=lambda r: r[2]) == [(1, i * 100 + 1, i + 1, MANY) for i in range(60)]
    assert not any(re.search(r"BroadcastHashJoin \[src#", plan) for plan, _ in written[:3])


def test_barrier_leaves_many_out(spark, make, written):
    stops = make([(5,), (MANY,)], "id bigint")
    reached = graph.expand(chain(spark), spark.range(MANY), 2, absorbing=stops, paths=False)
    assert reached.count() == MANY + 1 and not any(re.search(r"BroadcastHashJoin \[src#", plan) for plan, _ in written[:3])


def test_many_barriers_are_not_broadcast(spark, make, written):
    stops = spark.range(4, 3 * MANY, 2)
    reached = graph.expand(chain(spark), make([(1,), (7,)], "id bigint"), absorbing=stops, paths=False)
    assert rows_of(reached, "id", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3), (7, 0), (8, 1)]
    assert not any(re.search(r"BroadcastHashJoin \[id#", plan) for plan, _ in written)


def test_paths_to_many_barriers(spark, make, written, tmp_path):
    spark.range(MANY).selectExpr("id p_partkey", "'Brand#1' p_brand").write.parquet(str(tmp_path / "part.parquet"))
    make([(1, n, 100 + n, 1, 1.0, 1.0, 0.0, 0.0, "A", "O", "x") for n in range(3)], LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = plans.QUERIES["whole_paths_with_barrier"](spark, str(tmp_path))
    assert "BroadcastHashJoin [id#" not in "".join([found._jdf.queryExecution().executedPlan().toString(), *(plan for plan, _ in written)])
    assert rows_of(found) == sorted([(i, 0) for i in range(0, MANY, 100)] + [(101, 1)], key=repr)


def test_unreached_of_many_paths(spark, make):
    nodes = make([(i, "field", "x", "x", "a.java", 1) for i in (5, MANY - 1, MANY + 5)], "id bigint, kind string, name string, qualified_name string, file_path string, start_line int")
    edges = make([], "src bigint, dst bigint, kind string")
    found = graph.unreached_members(nodes, edges, nodes, spark.range(MANY).selectExpr("id target", "id leaf"))
    assert rows_of(found) == [(MANY + 5, MANY + 5)]
    assert not re.search(r"\[target#\w+, leaf#\w+\], LeftAnti, BuildRight", found._jdf.queryExecution().executedPlan().toString())


def test_keyed_frontier_is_not_broadcast(spark, written):
    roots = spark.range(MANY).selectExpr("id")
    assert graph.impact_radius(chain(spark), roots, 1).count() == MANY - 1
    assert len(written) >= 3 and not_gathered(written)


def test_keys_of_a_node_go_together(spark, make, written):
    rng = random.Random(7)
    pairs = {(rng.randrange(600), rng.randrange(600)) for _ in range(1500)}
    edges, seeds = make(sorted(pairs), "src int, dst int"), make([(i, i) for i in range(300)], "source int, id int")
    found = rows_of(graph.expand(edges, seeds, 4, ("source",), paths=False))
    assert found == sorted(((s, k, n) for s in range(300) for k, n in hops(pairs, [s], 4).items()), key=repr)
    most = max(table.count() for _, table in written)
    assert most <= max(1500, 2 * 600) < len(found) / 5


def test_leaves_stop_their_target_only(spark, make, written):
    rng = random.Random(3)
    leaves = [(f"t{i % 30}", f"l{i}") for i in range(90)]
    nodes = make([(t, "class", t, t, "src/main/a.java", 1) for t in sorted({t for t, _ in leaves})] + [(x, "method", x, x, "src/main/a.java", 1) for _, x in leaves], "id string, kind string, name string, qualified_name string, file_path string, start_line int")
    calls = {(rng.choice(leaves)[1], rng.choice(leaves)[1]) for _ in range(200)}
    row = lambda a, b, kind: (a, b, kind, 0, None, None, None)
    edges = make([row(t, x, "contains") for t, x in leaves] + [row(a, b, "calls") for a, b in sorted(calls)], "src string, dst string, kind string, line int, resolved_by string, synthesized_by string, confidence double")
    targets, columns = nodes.filter("kind = 'class'"), ("source", "target", "leaf", "hops")
    sources = nodes.select("id")
    expected = []
    for source in (r[0] for r in sources.collect()):
        members = [source, *(x for t, x in leaves if t == source)]
        for target in sorted({t for t, _ in leaves}):
            own = {x for t, x in leaves if t == target}
            expected += [(source, target, k, n) for k, n in hops(calls, members, 6, own).items() if k in own]
    assert len(expected) > 3000
    assert rows_of(graph.member_paths(nodes, edges, sources, targets, most=None), *columns) == sorted(expected, key=repr)
    before = len(written)
    assert rows_of(graph.member_paths(nodes, edges, sources, targets, most=None, paths=False), *columns) == sorted(expected, key=repr)
    assert max(table.count() for _, table in written[before:]) <= 120 * 30
