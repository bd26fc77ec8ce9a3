import random

import pytest

from graphloom.operators import graph

EDGES = "src long, dst long"


def closure(edges, nodes):
    reach = {n: {n} for n in nodes}
    for _ in nodes:
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
    return reach


@pytest.mark.parametrize("seed", [1, 2])
def test_loops_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    nodes = range(18)
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(22)]
    df = spark.createDataFrame(edges, EDGES)
    reach = closure(edges, nodes)
    both = closure(edges + [(b, a) for a, b in edges], nodes)
    used = {n for e in edges for n in e}
    assert {r.node: r.component for r in graph.components(df).collect()} == {n: min(both[n]) for n in used}
    scc = {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}
    on = {n for n in nodes if (n, n) in edges or any(m != n and n in reach[m] and m in reach[n] for m in nodes)}
    assert {r.node: r.component for r in graph.cycles(df).collect()} == {n: scc[n] for n in on} or {r.node for r in graph.cycles(df).collect()} == on
    depth, front = {0: 0}, {0}
    for k in range(1, 4):
        front = {b for a, b in edges if a in front} - set(depth)
        depth |= {n: k for n in front}
    assert {r.node: r.depth for r in graph.bfs(df, spark.createDataFrame([(0,)], "node long"), 3).collect()} == depth


def test_empty_graphs(spark):
    none = spark.createDataFrame([], EDGES)
    assert graph.components(none).count() == 0 and graph.cycles(none).count() == 0
    assert graph.bfs(none, spark.createDataFrame([(5,)], "node long"), 2).count() == 1
    assert graph.rank(spark.createDataFrame([], "node long"), none).count() == 0
    assert graph.traces(none, spark.createDataFrame([(5,)], "node long"), spark.createDataFrame([(5,)], "node long")).count() == 0


def test_rank_by_the_formula(spark):
    edges, n, s = [(1, 2), (1, 2), (1, 3), (2, 3)], 3, {1: 1 / 3, 2: 1 / 3, 3: 1 / 3}
    for _ in range(20):
        total = sum(s.values())
        s = {v: 0.15 / n + 0.85 * sum(s[a] / sum(x == a for x, _ in edges) for a, b in edges if b == v) + 0.85 * total / n for v in s}
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    got = {r.node: r.score for r in graph.rank(nodes, spark.createDataFrame(edges, EDGES)).collect()}
    assert all(abs(got[v] - s[v]) < 1e-9 * s[v] for v in s)
    fair = graph.rank(nodes, spark.createDataFrame(edges, EDGES), inflate=False)
    assert abs(sum(r.score for r in fair.collect()) - 1) < 1e-9


def test_trace_takes_the_first_of_the_shortest(spark):
    edges = [("e", "a", 1), ("e", "b", 0), ("a", "t", 0), ("b", "t", 2), ("e", "c", 0), ("c", "d", 0), ("d", "u", 0)]
    one = lambda *x: spark.createDataFrame([(k,) for k in x], "node string")
    got = graph.traces(spark.createDataFrame(edges, "src string, dst string, ord int"), one("e"), one("t", "u", "e")).collect()
    assert [(r.entry, r.path) for r in got] == [("e", ["e", "b", "t"])]


def test_rings_within_cycles(spark):
    """Pairs that point at each other, most of all arcs, lie on a larger cycle, on a tail and alone; one has a self-loop."""
    edges = [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 0), (0, 1), (4, 8), (8, 9), (9, 8), (9, 7), (20, 21), (21, 20), (21, 21), (30, 30), (5, 4)]
    got = {r.node: r.component for r in graph.cycles(spark.createDataFrame(edges * 2, EDGES)).collect()}
    assert got == {k: 0 for k in range(5)} | {8: 8, 9: 8, 20: 20, 21: 20, 30: 30}


def test_loops_send_no_tables_to_the_driver(spark):
    """Joins of a loop are not broadcast, though these tables are small enough: each one would go through the driver."""
    from graphloom import runtime

    plans, real = [], runtime.written

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    graph.written = watched
    try:
        graph.cycles(spark.range(60).selectExpr("id as src", "(id * 7 + 1) % 60 as dst")).collect()
        graph.components(spark.range(60).selectExpr("id as src", "id + 1 as dst")).collect()
        assert graph.rank(spark.range(60).withColumnRenamed("id", "node"), spark.range(60).selectExpr("id as src", "(id * 7) % 60 as dst"), 3).count() == 60
    finally:
        graph.written = real
    rounds = [p for p in plans if "ShuffledHashJoin" in p]
    assert not any("Broadcast" in p for p in plans) and len(rounds) == 3
    # of the arcs, which are in buckets, nothing is moved: a round moves scores and messages
    assert all(p.count("Exchange hashpartitioning") == 2 for p in rounds)
