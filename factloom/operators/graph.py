"""Graph queries over edges(src, dst) of any orderable type: reachability with budgets, slices, shortest paths, components.

The loops are semi-naive: a round joins only the new frontier with the edges and drops what was visited, and is written
to the shared folder, so plans stay short however deep the graph is.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import Dealt, buckets, ship, small, written


def reach(edges: DataFrame, sources: DataFrame, max_depth: int, max_visits: int | None = None, within: DataFrame | None = None, backward: bool = False, probe: bool = True, buckets: int | None = None) -> tuple[DataFrame, str]:
    """(node, depth) of all nodes reached from sources(node), with the number of edges on a shortest way, and the
    completeness: "complete", "depth_limit" or "visit_limit".

    The visit budget is applied to whole layers: the layer that exceeds it is the last. within(node) restricts the walk.
    probe: look past the depth limit to tell "complete" from "depth_limit"; without it a walk that meets the limit is
    called "depth_limit". buckets: of edges and nodes, where a caller knows better than by the number of edges."""
    if backward:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    frontier = sources.select("node")
    if within is not None:
        edges = edges.join(within.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi")
        frontier = frontier.join(within.select("node").distinct(), "node", "left_semi")
    return _walk(_dealt_edges(edges, buckets), frontier, max_depth, max_visits, probe)


def _dealt_edges(edges: DataFrame, n: int | None = None) -> Dealt:
    """edges(src, dst) as distinct (node, dst) in buckets of their first end."""
    edges = edges.where("src is not null and dst is not null").select(F.col("src").alias("node"), "dst")
    return Dealt(edges, "edges", ["node"], n or buckets(edges.count()))


def _walk(edges: Dealt, frontier: DataFrame, max_depth: int, max_visits: int | None = None, probe: bool = True) -> tuple[DataFrame, str]:
    """reach() over dealt edges. What was visited stands in buckets as the edges do: a round shuffles only what it finds."""
    at = lambda rows, depth: rows.select("node", F.lit(depth).alias("depth"))
    visited = Dealt(at(frontier.where("node is not null"), 0), "reach", ["node"], edges.n, keys=["node"])
    depth, visits = 0, visited.last.count() if max_visits is not None else 0
    while True:
        if depth == max_depth and not probe:
            return visited.rows, "depth_limit"
        following = visited.last.select("node").join(edges.rows, "node").select(F.col("dst").alias("node")).distinct()
        if depth == max_depth:
            return visited.rows, "complete" if following.join(visited.rows, "node", "left_anti").isEmpty() else "depth_limit"
        new = visited.add(at(following, depth + 1))
        if new.isEmpty():
            return visited.rows, "complete"
        depth += 1
        if max_visits is not None:
            visits += new.count()
            if visits > max_visits:
                return visited.rows, "visit_limit"


def slice_between(edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int) -> DataFrame:
    """(node, fwd_depth, bwd_depth) of the nodes on a way from a source to a sink: the backward walk is restricted to what
    the forward walk found, whose edges stand in the same buckets."""
    dealt = _dealt_edges(edges)
    forward, _ = _walk(dealt, sources.select("node"), max_depth, probe=False)
    nodes = forward.select("node")
    back = _dealt_edges(dealt.rows.join(nodes, "node", "left_semi").select(F.col("dst").alias("src"), F.col("node").alias("dst")), dealt.n)
    backward, _ = _walk(back, sinks.select("node").distinct().join(nodes, "node", "left_semi"), max_depth, probe=False)
    return forward.withColumnRenamed("depth", "fwd_depth").join(backward.withColumnRenamed("depth", "bwd_depth"), "node")


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth, path) of a shortest way from a source to each node; of several the one whose parents are smallest, seen
    from the node. Edges and what has a way stand in buckets; a round shuffles only what it finds."""
    dealt = _dealt_edges(edges)
    done = Dealt(sources.select("node", F.lit(0).alias("depth"), F.array("node").alias("path")), "paths", ["node"], dealt.n, keys=["node"])
    for depth in range(1, max_depth + 1):
        ways = done.last.select("node", "path").join(dealt.rows, "node")
        best = ways.groupBy("dst").agg(F.min_by("path", "node").alias("before"))
        best = best.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.concat("before", F.array("dst")).alias("path"))
        if done.add(best).isEmpty():
            break
    return done.rows


def pointers(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes but that one.

    A round points every node that has smaller neighbours to the smallest of them and follows pointers to their ends; only
    nodes that others point to can be in the middle, so only these are joined. An edge to a node's one smaller neighbour is its
    pointer and goes; edges of nodes with several are replaced by the ends of theirs. Only nodes that are smaller than all
    their neighbours are left, at most half, so the table shrinks from round to round, and a star is done in one."""
    left = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    left = written(left.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")), "edges")
    labels = []
    while True:
        label = written(left.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("root"), F.max("src").alias("high")), "labels")
        several = written(label.where("root <> high").select(F.col("node").alias("dst")), "several")
        label = _followed(label.select("node", "root"))
        labels.append(label)
        if several.isEmpty():
            break
        of = lambda c, to: label.select(F.col("node").alias(c), F.col("root").alias(to))  # noqa: E731, B023
        moved = left.join(several, "dst", "left_semi").join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst").select(F.coalesce("a", "src").alias("a"), "b").where("a <> b")
        left = written(moved.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
        if left.isEmpty():
            break
    found = labels[0]
    for label in labels[1:]:
        beyond = label.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = found.join(beyond, "root", "left").select("node", F.coalesce("last", "root").alias("root")).unionByName(label)
    return found if len(labels) == 1 else written(found, "found")


def _followed(label: DataFrame) -> DataFrame:
    """label(node, root) with pointers followed to their ends."""
    while True:
        ends = label.select(F.col("root").alias("node")).distinct()
        middle = written(label.join(ends, "node", "left_semi").select(F.col("node").alias("root"), F.col("root").alias("beyond")), "middle")
        if middle.isEmpty():
            return label
        label = written(label.join(middle, "root", "left").select("node", F.coalesce("beyond", "root").alias("root")), "labels")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, see pointers."""
    found = pointers(edges)
    every = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    alone = edges.where("src is not null and dst is not null and src = dst").select(F.col("src").alias("node")).distinct()
    return every.unionByName(alone.join(every, "node", "left_anti").select("node", F.col("node").alias("root")))


#: Graphs of at most so many edges are given to one task for their strong components.
LOCAL_EDGES = 200_000


def _tarjan(rows: pd.DataFrame) -> pd.DataFrame:
    out: dict = {}
    for a, b in zip(rows["src"].tolist(), rows["dst"].tolist(), strict=True):
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index, low, held, stack, found = {}, {}, set(), [], []
    for first in out:
        if first in index:
            continue
        work = [(first, iter(out[first]))]
        index[first] = low[first] = len(index)
        stack.append(first)
        held.add(first)
        while work:
            node, following = work[-1]
            for to in following:
                if to not in index:
                    index[to] = low[to] = len(index)
                    stack.append(to)
                    held.add(to)
                    work.append((to, iter(out[to])))
                    break
                if to in held:
                    low[node] = min(low[node], index[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    own = []
                    while not own or own[-1] != node:
                        own.append(stack.pop())
                        held.discard(own[-1])
                    root = max(own)
                    found += [(n, root) for n in own]
    return pd.DataFrame(found, columns=["node", "root"])


def strong_components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of the strongly connected components, named by their largest node.

    A graph of at most `local` edges, counted, is solved in one task. Beyond that by repeated colouring: the largest label
    spreads forward, and what reaches a label's own node backward within its colour is one component; the rest goes on.
    Both ways give the same rows."""
    edges = written(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "scc-edges")
    if edges.count() <= local:
        ship(edges.sparkSession)
        kind = edges.schema["src"].dataType.simpleString()
        return edges.groupBy(F.lit(0).alias("all")).applyInPandas(_tarjan, f"node {kind}, root {kind}")
    left = written(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "scc-nodes")
    found = None
    while not left.isEmpty():
        colour = left.withColumn("colour", F.col("node"))
        while True:
            arriving = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("c").alias("c"))
            step = written(colour.join(arriving, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("was")), "scc-colours")
            colour = step.select("node", "colour")
            if step.where("colour <> was").isEmpty():
                break
        painted = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("cs")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("cd")), "dst").where("cs = cd").select("src", "dst")
        roots = colour.where("node = colour").select("node")
        back, _ = reach(painted, roots, 1 << 30, backward=True)
        own = written(back.select("node").join(colour, "node").select("node", F.col("colour").alias("root")), "scc")
        found = own if found is None else found.unionByName(own)
        left = written(left.join(own, "node", "left_anti"), "scc-nodes")
        keep = left.select(F.col("node").alias("src"))
        edges = written(edges.join(keep, "src", "left_semi").join(keep.withColumnRenamed("src", "dst"), "dst", "left_semi"), "scc-edges")
    return found if found is not None else left.withColumn("root", F.col("node"))


def reach_condensed(edges: DataFrame, sources: DataFrame, max_depth: int, local: int = LOCAL_EDGES) -> tuple[DataFrame, str]:
    """Like reach, but the depth counts strongly connected components: moves inside one are free. local: see strong_components."""
    scc = written(strong_components(edges, local), "components")
    of = lambda c, to: scc.select(F.col("node").alias(c), F.col("root").alias(to))
    between = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    start = sources.join(scc, "node", "left").select(F.coalesce("root", "node").alias("node"))
    walked, state = reach(between, start, max_depth)
    nodes = walked.withColumnRenamed("node", "root").join(scc, "root").select("node", "depth")
    alone = sources.select("node").distinct().join(scc, "node", "left_anti").withColumn("depth", F.lit(0))
    return nodes.unionByName(alone), state


def union_by_labels(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Symmetric label propagation: (node, labels), each node of seeds(node, label) or edges with all labels of its
    component."""
    parts = components(edges)
    known = seeds.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sets = known.groupBy("root").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    nodes = parts.unionByName(known.select("node", "root")).distinct()
    return nodes.join(sets, "root", "left").select("node", F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def propagate(seeds: DataFrame, edges: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Monotone set propagation along edges until nothing is new: (node, fact) for every fact of seeds(node, fact) that
    reaches node. This is points-to propagation when facts are abstract objects. within: columns of both tables that ways
    keep to, which come first in the result.

    Facts and edges stand in buckets of their nodes; a round shuffles only what it finds."""
    edges = edges.select(*within, F.col("src").alias("node"), "dst").where("src is not null")
    n = buckets(edges.count())
    edges = Dealt(edges, "edges", [*within, "node"], n).rows
    known = Dealt(seeds.select(*within, "node", "fact"), "facts", [*within, "node"], n)
    while not known.last.isEmpty():
        moved = known.last.join(edges, [*within, "node"]).select(*within, F.col("dst").alias("node"), "fact")
        known.add(written(moved.distinct(), "found"))
    return known.rows


def pairs_within(start: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(sub, super, steps): start's pairs extended along edges(src, dst) from their second end, each pair with the fewest
    steps, up to `depth`. Rounds extend only the pairs that the round before found."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    known = written(start.select("sub", "super", "steps"), "pairs")
    delta = known
    for n in range(1, depth + 1):
        moved = delta.join(edges, delta["super"] == edges["src"]).select("sub", F.col("dst").alias("super")).distinct()
        delta = written(moved.join(known, ["sub", "super"], "left_anti").withColumn("steps", F.lit(n)), "pairs")
        if delta.isEmpty():
            break
        known = known.unionByName(delta)
    return known


def neighbours(edges: DataFrame, nodes: DataFrame, backward: bool = False) -> DataFrame:
    """(node, other): the successors, or predecessors, of nodes(node)."""
    here, there = ("dst", "src") if backward else ("src", "dst")
    return nodes.select("node").distinct().join(edges.select(F.col(here).alias("node"), F.col(there).alias("other")), "node").distinct()


#: Rows that a task gives, where a round gives very many.
TASK_ROWS = 2_000_000


def reaches(edges: DataFrame, starts: DataFrame, targets: DataFrame, depth: int) -> DataFrame:
    """(node, target, steps) of starts(node) that reach targets(node) in at most `depth` steps: a walk backward from the
    targets, of which each round extends only what is new.

    The last round, which gives most rows, isn't written or compared with those before: what a node leads to moves as arrays of
    numbers to the start's task, and is told apart there. A number moves as two bytes, its place in a lot of 65,536. Only starts
    are extended to."""
    named = written(targets.select("node").where("node is not null").distinct().withColumn("sub", F.monotonically_increasing_id()), "targets")
    known = named.select("sub", F.col("node").alias("super"), F.lit(0).alias("steps"))
    start = starts.select("node").where("node is not null").distinct()
    if depth > 1:
        known = pairs_within(known, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), depth - 1)
    lot, place = F.shiftright("sub", 16).alias("lot"), (F.col("sub").bitwiseAND(65535) - 32768).cast("short")
    rows = known.join(start.withColumnRenamed("node", "super"), "super", "left_semi").select(F.col("super").alias("node"), lot, F.array(place).alias("places"), "steps")
    tasks = 1
    if depth > 0:
        lots = known.where(F.col("steps") == depth - 1).groupBy("super", lot).agg(F.collect_list(place).alias("places"))
        lots = written(lots.select(F.col("super").alias("dst"), "lot", "places"), "lots")
        last = written(edges.select("src", "dst").join(start.withColumnRenamed("node", "src"), "src", "left_semi").join(lots.select("dst"), "dst", "left_semi").distinct(), "last")
        sizes = last.groupBy("dst").agg(F.count("*").alias("n")).join(lots.groupBy("dst").agg(F.sum(F.size("places")).alias("m")), "dst")
        tasks = -(-(sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) // TASK_ROWS) or 1
        rows = rows.unionByName(last.join(lots, "dst").select(F.col("src").alias("node"), "lot", "places", F.lit(depth).alias("steps")))
    sub = (F.shiftleft("lot", 16) + F.col("place") + 32768).alias("sub")
    pairs = rows.repartition(tasks, "node").select("node", "lot", F.explode("places").alias("place"), "steps").select("node", sub, "steps").groupBy("node", "sub").agg(F.min("steps").alias("steps"))  # no second shuffle
    return pairs.join(small(named.withColumnRenamed("node", "target")), "sub").select("node", "target", "steps")


def in_context(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(ctx, node, depth): reachability that stays within one calling context. edges(ctx, src, dst), seeds(ctx, node)."""
    at = lambda c: F.struct(F.col("ctx"), F.col(c).alias("node"))
    found, _ = reach(edges.select(at("src").alias("src"), at("dst").alias("dst")), seeds.select(at("node").alias("node")), depth, probe=False)
    return found.select("node.ctx", "node.node", "depth")


def propagate_in_context(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(ctx, node, fact): propagate() within each calling context. seeds(ctx, node, fact), edges(ctx, src, dst)."""
    return propagate(seeds, edges, ("ctx",))


def function_summaries(edges: DataFrame, params: DataFrame, returns: DataFrame) -> DataFrame:
    """(func, param, returned): which parameters of params(func, node) flow to which of returns(func, node) along
    edges(func, src, dst), each function by itself."""
    flows = propagate(params.select("func", "node", F.col("node").alias("fact")), written(edges, "edges"), ("func",))
    return flows.join(returns.select("func", "node").distinct(), ["func", "node"], "left_semi").select("func", F.col("fact").alias("param"), F.col("node").alias("returned"))


#: Edge kinds that carry data in each view of a flow graph.
VIEWS = {"full": None, "light": ("copy", "phi", "cast", "call", "return"), "taint": ("copy", "phi", "cast", "call", "return", "store", "load", "summary", "source", "sink")}


def data_edges(edges: DataFrame, view: str) -> DataFrame:
    """The edges(src, dst, kind) that a view looks along."""
    return edges if VIEWS[view] is None else edges.where(F.col("kind").isin(*VIEWS[view]))


def stats(edges: DataFrame) -> DataFrame:
    """(metric, value): nodes, edges, distinct edges, sources (nothing goes in), sinks (nothing goes out), self loops."""
    ends = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    by_node = ends.groupBy("node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    nodes = by_node.agg(F.count("*").alias("nodes"), F.count_if(F.col("i") == 0).alias("source_nodes"), F.count_if(F.col("o") == 0).alias("sink_nodes"))
    own = edges.groupBy("src", "dst").agg(F.count("*").alias("n")).agg(F.sum("n").alias("edges"), F.count("*").alias("distinct_edges"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("self_loops"))
    one = nodes.crossJoin(own)  # one row each
    names = ("nodes", "edges", "distinct_edges", "source_nodes", "sink_nodes", "self_loops")
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("value")) for n in names))).alias("x")).select("x.*")
