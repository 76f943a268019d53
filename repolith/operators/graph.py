"""Dependency graphs: edges, degrees, strongly connected components, views.

Edges are (graph_id, src, dst, line); one table holds the graphs of all projects.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.runtime import materialise

#: Graphs up to this many distinct edges are solved by one task each; larger ones by rounds over the whole table.
GROUPED_EDGES = 200_000


def distinct_edges(edges: DataFrame) -> DataFrame:
    """graph_id, src, dst, import_count, lines (sorted)."""
    return edges.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("import_count"), F.sort_array(F.collect_list("line")).alias("lines"))


def degrees(edges: DataFrame) -> DataFrame:
    """graph_id, node, in_degree, out_degree over distinct edges; 0 where a side has none."""
    once = edges.select("graph_id", "src", "dst").distinct()
    ends = once.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("graph_id", "x.node").agg(F.sum("x.i").alias("in_degree"), F.sum("x.o").alias("out_degree"))


def components_of(pairs: list[tuple]) -> list[list]:
    """Cycles of one graph: sets of nodes that reach each other, and single nodes with an edge to themselves.

    Forward and backward reach over arrays: nodes without a way in or out are trimmed,
    the first node left is taken, and what it reaches and is reached by is its
    component; what remains falls into three parts that share no component.
    """
    names = sorted({n for pair in pairs for n in pair})
    number = {n: i for i, n in enumerate(names)}
    ends = np.array([(number[a], number[b]) for a, b in pairs], np.int64).reshape(-1, 2)
    loops = set(ends[ends[:, 0] == ends[:, 1], 0].tolist())
    ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
    n = len(names)
    heads, tails = _neighbours(ends, n), _neighbours(ends[:, ::-1], n)
    part = np.zeros(n, np.int64)  # nodes of one part may still be in one component; -1 is done
    fresh, found, parts = 1, [], [np.arange(n)]
    while parts:
        inside = _trimmed(parts.pop(), part, heads, tails)
        if not len(inside):
            continue
        label = part[inside[0]]
        ahead, back = (_reach(int(inside[0]), label, part, step) for step in (heads, tails))
        mutual = np.intersect1d(ahead, back)
        if len(mutual) > 1:
            found.append(mutual.tolist())
        part[inside] = -1
        for rest in (np.setdiff1d(ahead, mutual), np.setdiff1d(back, mutual), np.setdiff1d(inside, np.union1d(ahead, back))):
            if len(rest):
                part[rest] = fresh
                fresh += 1
                parts.append(rest)
    joined = {i for group in found for i in group}
    found += [[i] for i in sorted(loops - joined)]
    return [[names[i] for i in sorted(group)] for group in found]


def _neighbours(ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(where the followers of each node begin, all followers)."""
    order = np.argsort(ends[:, 0], kind="stable")
    return np.searchsorted(ends[order, 0], np.arange(n + 1)), ends[order, 1]


def _trimmed(nodes: np.ndarray, part: np.ndarray, heads: tuple, tails: tuple) -> np.ndarray:
    """``nodes`` without those that nothing in their part leads to, or that lead to nothing in it."""
    label = part[nodes[0]]
    pending = list(nodes.tolist())
    counts = {}
    for side, (starts, others) in enumerate((heads, tails)):
        for v in pending:
            counts[v, side] = int((part[others[starts[v] : starts[v + 1]]] == label).sum())
    pending = [v for v in pending if not counts[v, 0] or not counts[v, 1]]
    while pending:
        v = pending.pop()
        if part[v] != label:
            continue
        part[v] = -1
        for side, (starts, others) in ((1, heads), (0, tails)):  # who follows v loses a way in, who leads to v a way out
            for w in others[starts[v] : starts[v + 1]].tolist():
                if part[w] == label:
                    counts[w, side] -= 1
                    if not counts[w, side]:
                        pending.append(w)
    return nodes[part[nodes] == label]


def _reach(start: int, label: int, part: np.ndarray, step: tuple) -> np.ndarray:
    """Everything of the part that is reached from ``start``."""
    starts, others = step
    seen, work = {start}, [start]
    while work:
        v = work.pop()
        for w in others[starts[v] : starts[v + 1]].tolist():
            if w not in seen and part[w] == label:
                seen.add(w)
                work.append(w)
    return np.array(sorted(seen), np.int64)


def _grouped(edges: DataFrame) -> DataFrame:
    """Components of bounded graphs, one task per graph."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = components_of(list(zip(pdf["src"], pdf["dst"])))
        rows = [(pdf["graph_id"].iloc[0], g[0], n) for g in groups for n in g]
        return pd.DataFrame(rows, columns=["graph_id", "component", "node"])

    kinds = dict(edges.dtypes)
    ddl = f"graph_id {kinds['graph_id']}, component {kinds['src']}, node {kinds['src']}"
    return edges.groupBy("graph_id").applyInPandas(solve, ddl)


def _rounds(edges: DataFrame) -> DataFrame:
    """Components by trimming and colouring: every step is a join over the whole edge table.

    Each node takes the largest label that reaches it; a node that keeps its own
    label is a root, and its component is what reaches it within its colour.
    """
    rest = materialise(edges.select("graph_id", "src", "dst").distinct())
    found: DataFrame | None = None
    loops = rest.where("src = dst").select("graph_id", F.col("src").alias("component"), F.col("src").alias("node"))
    rest = materialise(rest.where("src <> dst"))
    while True:
        while True:  # nodes without a way in or out are in no cycle
            src, dst = rest.select("graph_id", F.col("src").alias("n")).distinct(), rest.select("graph_id", F.col("dst").alias("n")).distinct()
            inner = src.join(dst, ["graph_id", "n"])
            slim = rest.join(inner.withColumnRenamed("n", "src"), ["graph_id", "src"], "left_semi").join(inner.withColumnRenamed("n", "dst"), ["graph_id", "dst"], "left_semi")
            slim = materialise(slim.select("graph_id", "src", "dst"))
            before, after = rest.count(), slim.count()
            rest = slim
            if before == after:
                break
        if not rest.take(1):
            break
        nodes = rest.select("graph_id", F.col("src").alias("node")).distinct().withColumn("color", F.col("node"))
        nodes = _spread(materialise(nodes), rest.select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b")), "color")
        roots = nodes.where("node = color").withColumn("hit", F.lit(True))
        inside = rest.join(nodes.select("graph_id", F.col("node").alias("src"), F.col("color").alias("c1")), ["graph_id", "src"]).join(nodes.select("graph_id", F.col("node").alias("dst"), F.col("color").alias("c2")), ["graph_id", "dst"]).where("c1 = c2")
        back = materialise(inside.select("graph_id", F.col("dst").alias("a"), F.col("src").alias("b")))
        marked = nodes.join(roots.select("graph_id", "node", "hit"), ["graph_id", "node"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        marked = _spread(materialise(marked), back, "hit").where("hit")
        sized = marked.groupBy("graph_id", "color").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("component"))
        groups = marked.join(sized.where("n > 1"), ["graph_id", "color"]).select("graph_id", "component", "node")
        found = materialise(groups if found is None else found.unionByName(groups))
        done = marked.select("graph_id", F.col("node"))
        rest = rest.join(done.withColumnRenamed("node", "src"), ["graph_id", "src"], "left_anti").join(done.withColumnRenamed("node", "dst"), ["graph_id", "dst"], "left_anti")
        rest = materialise(rest.select("graph_id", "src", "dst"))
    if found is None:
        return loops
    alone = loops.join(found.select("graph_id", "node"), ["graph_id", "node"], "left_anti").select("graph_id", "component", "node")
    return found.unionByName(alone)


def _spread(nodes: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """Largest value of ``column`` that reaches each node along edges (a -> b), until nothing changes."""
    while True:
        sent = edges.join(nodes.select("graph_id", F.col("node").alias("a"), F.col(column).alias("v")), ["graph_id", "a"]).groupBy("graph_id", F.col("b").alias("node")).agg(F.max("v").alias("v"))
        joined = nodes.join(sent, ["graph_id", "node"], "left")
        nxt = joined.withColumn("__new", F.greatest(F.col(column), F.coalesce("v", F.col(column)))).withColumn("__moved", F.col("__new") != F.col(column))
        nxt = materialise(nxt)
        moved = nxt.where("__moved").limit(1).count()
        nodes = nxt.drop("v", "__moved", column).withColumnRenamed("__new", column)
        if not moved:
            return nodes


def strongly_connected(edges: DataFrame, *, grouped_edges: int = GROUPED_EDGES) -> DataFrame:
    """graph_id, component (its smallest member), node of every cycle.

    Graphs of bounded size are solved by one task each, the others by rounds over
    all of them together; both are exact. Self-loops count; null ends are left out.
    """
    pairs = materialise(edges.where("graph_id is not null and src is not null and dst is not null").select("graph_id", "src", "dst").distinct())
    sizes = pairs.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    small = _grouped(pairs.join(sizes.where(F.col("n") <= grouped_edges), "graph_id", "left_semi"))
    large = sizes.where(F.col("n") > grouped_edges)
    if not large.take(1):
        return small
    return small.unionByName(_rounds(pairs.join(large, "graph_id", "left_semi")))


def ranking(edges: DataFrame, components: DataFrame) -> DataFrame:
    """graph_id, node, degrees, in_cycle: cycle members first, then by degree, then by name."""
    inside = components.select("graph_id", "node").distinct().withColumn("in_cycle", F.lit(True))
    return degrees(edges).join(inside, ["graph_id", "node"], "left").withColumn("in_cycle", F.coalesce("in_cycle", F.lit(False))).withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def two_hops(edges: DataFrame, *, salts: int = 8) -> DataFrame:
    """graph_id, node, caller: callers of callers, without direct callers and the node itself.

    A hub in the middle pairs all its callers with all it calls; its callers are
    dealt out to ``salts`` parts, each of which meets a copy of what it calls, so
    that no task gets the pairs of a whole hub.
    """
    once = edges.select("graph_id", "src", "dst").where("src <> dst").distinct()
    direct = once.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("via"))
    callers = once.select("graph_id", F.col("dst").alias("via"), F.col("src").alias("caller"), F.pmod(F.xxhash64("src"), F.lit(salts)).alias("salt"))
    copies = direct.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    far = copies.join(callers, ["graph_id", "via", "salt"]).where("caller <> node")
    return far.select("graph_id", "node", "caller").distinct().join(direct.withColumnRenamed("via", "caller"), ["graph_id", "node", "caller"], "left_anti")
