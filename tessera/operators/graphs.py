"""Graph kernels on edge tables: components, strongly connected components, closure, depth, modularity.

Fixpoints are loops over written tables (``tessera.operators.store``), so no lineage
grows and a lost executor costs a recomputation of tasks, not of rounds. Module graphs
have thousands of nodes, not billions: where a grouping key (a profile) splits them, the
sequential algorithms run one graph a task in ``applyInPandas``.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.store import counted, written


#: Rows of a table that a join may hold in every executor. Sorted tables of numbers are so small as files that Spark would send millions of rows through the driver.
FEW = 100_000


def _joined(table: DataFrame, rows: int) -> DataFrame:
    """``table`` as it enters joins: beyond ``FEW`` rows neither side is broadcast."""
    return table if rows <= FEW else table.hint("merge")


def _kept(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` written, as it enters joins, and its count of rows."""
    table, told = counted(df, name, rows=F.count("*"))
    return _joined(table, told["rows"]), told["rows"]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b): the component is its smallest node. Labels and jumps to labels' labels, until stable."""
    both, _ = _kept(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels, nodes = _kept(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("component")), "labels")
    moved = nodes
    while moved:
        seen = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(seen, labels["node"] == seen["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = _joined(labels.select(F.col("node").alias("component"), F.col("component").alias("further")), nodes)
        table, told = counted(new.join(jump, "component").select("node", "old", F.col("further").alias("component")), "labels", moved=F.count_if(F.col("component") != F.col("old")))
        moved = told["moved"]
        labels = _joined(table.select("node", "component"), nodes)
    return labels


def reachable(edges: DataFrame) -> DataFrame:
    """(src, dst) pairs joined by a path of one edge or more: semi-naive closure, each round extending only what is new."""
    edges, _ = _kept(edges.select("src", "dst").distinct(), "edges")
    known, fresh = edges, edges
    while True:
        step = fresh.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("end")), "dst").select("src", F.col("end").alias("dst")).distinct()
        fresh, rows = _kept(step.join(known, ["src", "dst"], "left_anti"), "fresh")
        if not rows:
            return known
        known, _ = _kept(known.union(fresh), "known")


def propagation_cost(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, reachable pairs with the diagonal, and their share of all pairs (0 without nodes)."""
    pairs = reachable(edges).where("src != dst").agg(F.count("*").alias("p"))
    n = nodes.select("node").distinct().agg(F.count("*").alias("nodes"))
    total = F.col("p") + F.col("nodes")
    return n.join(pairs, how="cross").select("nodes", total.alias("reachable_pairs"), F.when(F.col("nodes") > 0, total / (F.col("nodes") * F.col("nodes"))).otherwise(0.0).alias("propagation_cost"))


def _grown(start: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the least label over the node's own in ``start`` and those of all nodes with a path to it along ``edges`` (src, dst)."""
    labels, _ = _kept(start, name)
    while True:
        into = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("l")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("l").alias("l"))
        new = labels.join(into, "node", "left").select("node", F.least("label", "l").alias("label"), F.col("label").alias("old"))
        table, told = counted(new, name, rows=F.count("*"), moved=F.count_if(~F.col("label").eqNullSafe(F.col("old"))))
        labels = _joined(table.select("node", "label"), told["rows"])
        if not told["moved"]:
            return labels


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the nodes on a cycle of more than one node; the component is its smallest node.

    By colouring: every node takes the least node that reaches it, and what reaches a colour's own node within the colour is its component. These
    leave, with all edges between colours, and the rest is coloured anew. Nodes without an edge in or out are trimmed first. No closure is made:
    every table has as many rows as nodes or edges.
    """
    kind = edges.schema["src"].dataType
    live, count = _kept(edges.where("src != dst").select("src", "dst").distinct(), "edges")
    found = edges.sparkSession.createDataFrame([], T.StructType([T.StructField("node", kind), T.StructField("component", kind)]))
    while True:
        while count:
            inner = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            before = count
            live, count = _kept(inner.select("src", "dst"), "edges")
            if count == before:
                break
        if not count:
            break
        nodes = live.select(F.col("src").alias("node")).distinct()
        colour = _grown(nodes.withColumn("label", F.col("node")), live, "colours")
        one, two = colour.toDF("src", "p"), colour.toDF("dst", "q")
        inside, _ = _kept(live.join(one, "src").join(two, "dst").where("p = q").select("src", "dst"), "inside")
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        reached = _grown(colour.select("node", F.when(F.col("node") == F.col("label"), F.col("label")).alias("label")), back, "reached").where("label is not null")
        found = written(found.union(reached.select("node", F.col("label").alias("component"))), "components")
        gone = reached.select("node")
        rest = inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        live, count = _kept(rest.select("src", "dst"), "edges")
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return found.join(sizes, "component").select("node", "component", "size")


def longest_path(parents: DataFrame) -> DataFrame:
    """(node, depth) over (node, parent) rows without cycles; a node with only unknown or null parents has depth 0.

    Level by level from the nodes without a parent: a node is in every level at which a path ends in it, in a tree in one; the last is its depth.
    """
    nodes = parents.select("node").distinct()
    nodes, bound = _kept(nodes, "nodes")
    links, _ = _kept(parents.join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node", "parent").distinct(), "links")
    level, rows = _kept(nodes.join(links.select("node"), "node", "left_anti"), "level")
    depth, levels = nodes.withColumn("depth", F.lit(0).cast("long")), []
    for at in range(1, bound + 1):
        level, rows = _kept(links.join(_entering(level, rows).withColumnRenamed("node", "parent"), "parent").select("node").distinct(), "level")
        if not rows:
            break
        levels.append(level.withColumn("depth", F.lit(at).cast("long")))
        if len(levels) == 32:
            depth, levels = written(_deepest(depth, levels), "depth"), []
    return _deepest(depth, levels)


def _entering(level: DataFrame, rows: int) -> DataFrame:
    """A small level meets the links where they lie."""
    return F.broadcast(level) if rows <= FEW else level


def _deepest(depth: DataFrame, levels: list[DataFrame]) -> DataFrame:
    for level in levels:
        depth = depth.union(level)
    return depth.groupBy("node").agg(F.max("depth").alias("depth"))


def declared_modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Newman's Q of the given communities over undirected weights (an edge each way weighs two): one row."""
    weights = edges.where("src != dst").select("src", "dst").distinct()
    of = members.select(F.col("node"), F.col("community"))
    ends = weights.join(of.withColumnRenamed("node", "src").withColumnRenamed("community", "p"), "src").join(
        of.withColumnRenamed("node", "dst").withColumnRenamed("community", "q"), "dst"
    )
    total = ends.agg(F.count("*").alias("m"), F.count_if(F.col("p") == F.col("q")).alias("inside"))
    degree = ends.select(F.col("p").alias("c")).union(ends.select("q")).groupBy("c").agg(F.count("*").alias("d"))
    squares = degree.agg(F.coalesce(F.sum(F.col("d") * F.col("d")), F.lit(0)).alias("s"))
    m = F.col("m")
    return total.join(squares, how="cross").select(F.when(m > 0, F.col("inside") / m - F.col("s") / (4.0 * m * m)).otherwise(0.0).alias("q_declared"))


# ---- one graph a task -------------------------------------------------------------------------------------------------


def tarjan(nodes: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected components of more than one node, members sorted; the largest first, then by first member. Iterative."""
    out = defaultdict(list)
    for a, b in edges:
        if a != b:
            out[a].append(b)
    index, low, on, stack, found = {}, {}, set(), [], []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(stack.pop())
                        on.discard(group[-1])
                    if len(group) > 1:
                        found.append(sorted(group))
    return sorted(found, key=lambda g: (-len(g), g[0]))


def reach_count(nodes: list[str], edges: list[tuple[str, str]]) -> int:
    """Pairs (a, b) with a path from a to b, every node reaching itself."""
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    total = 0
    for start in nodes:
        seen, todo = {start}, [start]
        while todo:
            for w in out[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        total += len(seen)
    return total


def modularity(weights: dict[int, dict[int, float]], community: list[int]) -> float:
    """Newman's Q over symmetric weights; 0 without edges."""
    double = sum(sum(row.values()) for row in weights.values())
    if not double:
        return 0.0
    inside, degree = defaultdict(float), defaultdict(float)
    for a, row in weights.items():
        for b, w in row.items():
            degree[community[a]] += w
            if community[a] == community[b]:
                inside[community[a]] += w
    return sum(inside[c] / double - (degree[c] / double) ** 2 for c in degree)


def detected_communities(n: int, weights: dict[int, dict[int, float]]) -> list[int]:
    """Greedy modularity by local moves and coarsening. Nodes in order; a move needs a gain of more than 1e-12; ties go to the lower community."""
    labels = list(range(n))
    graph, size = {a: dict(r) for a, r in weights.items()}, n
    while True:
        double = sum(sum(r.values()) for r in graph.values())
        if not double:
            return labels
        degree = [sum(graph.get(v, {}).values()) for v in range(size)]
        at, total = list(range(size)), list(degree)
        changed, moved = True, False
        while changed:
            changed = False
            for v in range(size):
                links = defaultdict(float)
                for w, x in graph.get(v, {}).items():
                    if w != v:
                        links[at[w]] += x
                home = at[v]
                total[home] -= degree[v]
                best, gain = home, links.get(home, 0.0) - total[home] * degree[v] / double
                for c in sorted(links):
                    g = links[c] - total[c] * degree[v] / double
                    if g > gain + 1e-12:
                        best, gain = c, g
                total[best] += degree[v]
                if best != home:
                    at[v], changed, moved = best, True, True
        names = {c: i for i, c in enumerate(sorted(set(at)))}
        labels = [names[at[x]] for x in labels]
        if not moved:
            return labels
        smaller: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
        for a, r in graph.items():
            for b, x in r.items():
                smaller[names[at[a]]][names[at[b]]] += x
        graph, size = {a: dict(r) for a, r in smaller.items()}, len(names)


def symmetric_weights(nodes: list[str], edges: list[tuple[str, str]]) -> dict[int, dict[int, float]]:
    """Undirected weights by node number; an edge in each direction weighs two."""
    number = {x: i for i, x in enumerate(nodes)}
    weights: dict[int, dict[int, float]] = defaultdict(lambda: defaultdict(float))
    for a, b in sorted(set(edges)):
        if a != b:
            weights[number[a]][number[b]] += 1.0
            weights[number[b]][number[a]] += 1.0
    return {a: dict(r) for a, r in weights.items()}


def graph_panel(nodes: pd.DataFrame, edges: pd.DataFrame) -> dict:
    """Everything that needs the whole graph at once: tangles under three edge filters, propagation cost, modularities."""
    names = nodes["node"].tolist()
    community = pd.factorize(nodes["community"])[0].tolist() if len(nodes) else []
    pairs = list(zip(edges["src"], edges["dst"], strict=True))
    lasting = [p for p, ok in zip(pairs, edges["runtime"] | edges["local"], strict=True) if ok]
    runtime = [p for p, ok in zip(pairs, edges["runtime"], strict=True) if ok]
    tangles = tarjan(names, pairs)
    weights = symmetric_weights(names, pairs)
    found = detected_communities(len(names), weights)
    declared, detected = modularity(weights, community), modularity(weights, found)
    n, of = len(names), dict(zip(nodes["node"], nodes["community"], strict=True))
    return {
        "modules": n, "edges": len(set(pairs)), "packages": len(set(of.values())), "package_edges": len({(of[a], of[b]) for a, b in pairs if of[a] != of[b]}), "tangles": tangles, "runtime_tangles": len(tarjan(names, lasting)), "load_bearing_tangles": len(tarjan(names, runtime)),
        "largest_tangle": max(map(len, tangles), default=0), "in_cycles": sum(map(len, tangles)),
        "propagation_cost": reach_count(names, pairs) / n**2 if n else 0.0, "q_declared": declared, "q_detected": detected, "modularity_gap": detected - declared,
        "communities": len(set(found)),
    }
