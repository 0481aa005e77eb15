from __future__ import annotations

import random

import pytest
from conftest import rows_of

from sparkloom.plans import graph as plans

LINE = "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate string"


@pytest.fixture
def star(make, tmp_path):
    """Folder with parts and lines, and the pairs of consecutive lines; few of the lines are small."""
    rng = random.Random(4)
    parts = [(i, f"p{i}", f"Brand#{i % 7}", "T", 2) for i in range(1, 1001)]
    lines = [(o, n, rng.randint(1, 1000), 1, float(rng.randint(1, 50)), 1.0, 0.0, 0.0, rng.choice("ARN"), "O", "x") for o in range(300) for n in range(1, rng.randint(2, 6))]
    make(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    make(lines, LINE).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path), {(a[2], b[2]) for a, b in zip(lines, lines[1:]) if a[0] == b[0]}


def hops(pairs, seeds, depth, barrier=()):
    """Least hops from the seeds by brute force."""
    found, level = {s: 0 for s in seeds}, set(seeds)
    for n in range(1, depth + 1):
        level = {b for a, b in pairs if a in level and (n == 1 or a not in barrier)} - set(found)
        found |= dict.fromkeys(level, n)
    return found


def test_whole_graph_matches_brute_force(spark, star):
    d, pairs = star
    back, seeds = {(b, a) for a, b in pairs}, range(100, 1001, 100)
    barrier = {i for i in range(1, 1001) if i % 7 == 1}
    ask = lambda name: rows_of(plans.QUERIES[f"whole_{name}"](spark, d))
    of = lambda found: sorted(found.items(), key=repr)
    assert rows_of(plans.part_edges(spark, d).select("src", "dst").distinct()) == sorted(pairs, key=repr)
    assert ask("reach_forward") == of(hops(pairs, seeds, 6)) and ask("reach_backward") == of(hops(back, seeds, 6))
    assert ask("callers_of") == of({k: n for k, n in hops(back, seeds, 2).items() if n})
    stopped = hops(pairs, seeds, 6, barrier)
    assert ask("paths_with_barrier") == of({k: n for k, n in stopped.items() if k in barrier})
    assert ask("unreached_members") == sorted(((k,) for k in barrier - set(stopped)), key=repr)
    assert ask("file_dependents") == sorted({(f"src/main/Brand{b % 7}.java", f"src/main/Brand{a % 7}.java") for a, b in pairs if a % 7 != b % 7}, key=repr)


def test_depth_of_scoped_and_shortest(spark, star):
    d, pairs = star
    pairs = {(a, b) for a, b in pairs}
    lengths = sorted(((s, k, n) for s in range(100, 1001, 100) for k, n in hops(pairs, [s], 6).items()), key=repr)
    assert max(n for *_, n in lengths) > 4 and rows_of(plans.QUERIES["whole_shortest_path_len"](spark, d)) == lengths
    symbols = {(a, b) for a, b in pairs if b % 6 != 5}
    scoped = sorted(((k, n) for k, n in hops(symbols, range(100, 1001, 100), 6).items() if n), key=repr)
    assert max(n for _, n in scoped) > 3 and rows_of(plans.QUERIES["reach_scoped"](spark, d)) == scoped


def test_paths_of_every_source_and_target(spark, make, tmp_path):
    d = str(tmp_path)
    write = lambda name, rows, schema: make(rows, schema).write.parquet(f"{d}/{name}.parquet")
    write("region", [(0, "R")], "r_regionkey int, r_name string")
    write("nation", [(n, f"N{n}", 0) for n in range(40)], "n_nationkey int, n_name string, n_regionkey int")
    write("customer", [(c, f"C{c}", c % 40) for c in range(80)], "c_custkey int, c_name string, c_nationkey int")
    write("supplier", [(0, "S", 0)], "s_suppkey int, s_name string, s_nationkey int")
    write("orders", [(o, o % 80) for o in range(0, 1000, 50)], "o_orderkey int, o_custkey int")
    own = {(f"n{c % 40}", f"n{c % 40}", f"c{c}", 0) for c in range(80)}
    made = {(f"o{o}", f"n{o % 80 % 40}", f"c{o % 80}", 1) for o in range(0, 1000, 100)}
    assert rows_of(plans.QUERIES["member_paths"](spark, d)) == sorted(own | made, key=repr)
