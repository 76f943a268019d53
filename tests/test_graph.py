"""Strongly connected components: both ways against a reachability closure."""

from __future__ import annotations

import random

from repolith.operators import graph as G

DDL = "graph_id int, src string, dst string, line int"


def closure(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {b for a, b in pairs if a == n} for n in nodes}
    moved = True
    while moved:
        moved = False
        for n in nodes:
            more = set().union(reach[n], *[reach[m] for m in reach[n]])
            if more != reach[n]:
                reach[n], moved = more, True
    return sorted({tuple(sorted(m for m in nodes if n in reach[m] and m in reach[n])) for n in nodes if n in reach[n]})


def as_groups(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.graph_id, r.component), []).append(r.node)
    return sorted((k[0], tuple(sorted(v))) for k, v in out.items())


def test_components_of_random_graphs():
    rng = random.Random(1709)
    for _ in range(80):
        pairs = [(a, b) for a in range(10) for b in range(10) if rng.random() < 0.15]
        assert sorted(map(tuple, G.components_of(pairs))) == closure(pairs)


def test_long_chain_and_ring():
    chain = [(i, i + 1) for i in range(5000)]
    assert G.components_of(chain) == [] and len(G.components_of([*chain, (5000, 0)])[0]) == 5001


def test_both_ways_agree(spark):
    rng = random.Random(5)
    rows = [(g, f"n{rng.randint(0, 7)}", f"n{rng.randint(0, 7)}", 1) for g in range(4) for _ in range(11)]
    want = sorted((g, c) for g in range(4) for c in closure({(a, b) for h, a, b, _ in rows if h == g}))
    edges = spark.createDataFrame(rows + [(None, "a", "b", 1), (1, None, "b", 1)], DDL)
    assert as_groups(G.strongly_connected(edges)) == want
    assert as_groups(G.strongly_connected(edges, grouped_edges=0)) == want


def test_empty(spark):
    assert G.strongly_connected(spark.createDataFrame([], DDL)).count() == 0


def test_two_hops_and_degrees(spark):
    edges = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 2), (1, "a", "b", 5), (1, "d", "c", 3), (1, "c", "c", 9)], DDL)
    assert {(r.node, r.caller) for r in G.two_hops(edges).collect()} == {("c", "a")}
    assert {(r.node, r.in_degree, r.out_degree) for r in G.degrees(edges).collect()} == {("a", 0, 1), ("b", 1, 1), ("c", 3, 1), ("d", 0, 1)}
