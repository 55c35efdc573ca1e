"""Graphs against plain Python, and the streaming watch."""

from __future__ import annotations

import random

import pytest
from plumbline.operators import graph
from plumbline.streaming import changes
from pyspark.sql import functions as F

EDGES = "src string, dst string"


def _reach(edges, start):
    seen, front, step = {}, {start}, 0
    while front:
        step += 1
        front = {b for a, b in edges if a in front} - set(seen)
        seen.update(dict.fromkeys(front, step))
    return seen


def _graph(spark, edges, nodes):
    return spark.createDataFrame(edges, EDGES), spark.createDataFrame([(n,) for n in nodes], "node string")


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(25)]
    edges = [(r.choice(nodes), r.choice(nodes)) for _ in range(28)] + [("n1", "n1")]
    e, n = _graph(spark, edges, nodes)
    reach = {v: _reach(edges, v) for v in nodes}
    on_cycle = {v for v in nodes if v in reach[v]}
    assert {x.node for x in graph.cycles(e, n).collect()} == on_cycle
    old, graph.CORE_EDGES = graph.CORE_EDGES, 0
    try:
        assert {x.node for x in graph.cycles(e, n).collect()} == on_cycle
    finally:
        graph.CORE_EDGES = old
    assert {(x.start, x.node): x.distance for x in graph.closure(e, n).collect()} == {(a, b): d for a in nodes for b, d in reach[a].items()}
    levels = {x.node: x.level for x in graph.topo_levels(e, n).collect()}
    assert set(levels) == set(nodes)
    assert {v for v, k in levels.items() if k < 0} == {v for v in nodes if v in on_cycle or on_cycle & set(reach[v])}
    for v, k in levels.items():
        if k >= 0:
            assert k == max((levels[b] + 1 for a, b in edges if a == v), default=0)


def test_empty_graph_and_self_edges(spark):
    e, n = _graph(spark, [], [])
    assert graph.topo_levels(e, n).count() == graph.cycles(e, n).count() == graph.closure(e, n).count() == graph.dep_tree(e, n).count() == graph.in_degree(e).count() == 0
    e, n = _graph(spark, [("a", "a"), ("b", "a")], ["a", "b"])
    assert {x.node: x.level for x in graph.topo_levels(e, n).collect()} == {"a": -1, "b": -1}
    assert {x.node: x.level for x in graph.topo_levels(e, n, ignore_self=True).collect()} == {"a": 0, "b": 1}


def test_tree_expands_repeated_subtrees_and_ends_at_cycles(spark):
    e, n = _graph(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], ["a"])
    assert sorted((x.path, x.depth) for x in graph.dep_tree(e, n).collect()) == [("a", 0), ("a > b", 1), ("a > b > d", 2), ("a > c", 1), ("a > c > d", 2)]
    deep = [(f"n{i}", f"n{i + 1}") for i in range(14)]
    assert graph.dep_tree(*_graph(spark, deep, ["n0"])).count() == 15


def test_exact_order():
    assert graph.kahn_order(["a", "b", "c"], [("a", "b"), ("b", "c")]) == (["c", "b", "a"], [])
    order, stuck = graph.kahn_order(["a", "b", "c"], [("a", "b"), ("b", "a"), ("a", "c")])
    assert set(stuck) == {"a", "b", "c"} and graph.kahn_order(["a"], [("a", "a")], self_edges=False) == (["a"], [])


def test_watch_rechecks_what_changes(spark, tmp_path):
    folder, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    write = lambda rows: spark.createDataFrame(rows, changes.SCHEMA).write.mode("append").parquet(folder)
    check = lambda df: df.where(F.col("source_text").contains("unwrap")).select("module")
    write([("a", "x.unwrap()", None), ("b", "fine", None)])
    changes.watch(spark, folder, check, sink, mark).awaitTermination(120)
    assert sorted(x.module for x in spark.read.parquet(sink).collect()) == ["a"]
    write([("c", "y.unwrap()", None)])
    changes.watch(spark, folder, check, sink, mark).awaitTermination(120)
    assert sorted((x.module, x.batch) for x in spark.read.parquet(sink).collect()) == [("a", 0), ("c", 1)]

def test_ways_that_meet_in_one_node_are_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", 0)
    edges = [(f"n{i}", "n0") for i in range(1, 8)] + [("n0", "z"), ("n5", "n6")]
    nodes, plans = [f"n{i}" for i in range(8)], []

    def ways(path):
        yield " > ".join(path), len(path) - 1
        for b in sorted({b for a, b in edges if a == path[-1] and b not in path}):
            yield from ways([*path, b])

    kept = graph.written
    monkeypatch.setattr(graph, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    out = graph.dep_tree(*_graph(spark, edges, nodes))
    assert sorted(map(tuple, out.collect())) == sorted(w for n in nodes for w in ways([n]))
    joined = [p for p in plans if "Join" in p]
    assert joined and all("ShuffledHashJoin" in p and "SortMergeJoin" not in p for p in joined)


def test_closure_of_all_nodes_doubles(spark, monkeypatch):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(40)] + [("n40", "n20"), ("n3", "n30")]
    rounds, kept = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: rounds.append(1) or kept(df))
    e, n = _graph(spark, edges, [f"n{i}" for i in range(41)])
    found = {(x.start, x.node): x.distance for x in graph.closure(e, n).collect()}
    assert found == {(a, b): d for a in (f"n{i}" for i in range(41)) for b, d in _reach(edges, a).items()}
    # log2 of the longest distance, not the distance
    assert len(rounds) < 12
    some = graph.closure(e, _graph(spark, [], ["n5", "n39", "other"])[1]).collect()
    assert {(x.start, x.node): x.distance for x in some} == {k: d for k, d in found.items() if k[0] in ("n5", "n39")}
