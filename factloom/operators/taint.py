"""Taint analysis over flow graphs: slices, label transforms along ways, and one witness for each source and sink.

flow_edges(src, dst, kind, site, remove, add): kind is "flow", "enter" (actual to formal at a call site) or "leave"
(formal to actual); remove and add are label arrays. sources(node, rule_id, kind), sinks(node, rule_id, kind, location).

The slices are distributed joins. The witness search runs per (sink rule, sink location) over the sliced edges, because
what was already reported there decides what is searched next; it is bounded by states and tells
when the bound was met.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import risk
from factloom.operators import graph
from factloom.session import ship, small, written

EDGE_DDL = "src long, dst long, kind string, site long, remove array<string>, add array<string>"
#: Search states for a source and a sink, failed attempts for a sink (an exhausted search counts for four),
#: findings in all.
STATES, FAILURES, EXHAUSTED, FINDINGS = 4000, 8, 4, 20_000
#: The rule and kind of the row that tells that there are more findings than are given.
RESULT_LIMIT, LIMIT_KIND = "TAINT-RESULT-LIMIT", "analysis-limit"
FINDING_DDL = "source_rule_id string, sink_rule_id string, source_kind string, sink_kind string, source_node long, sink_node long, location string, path array<long>, completeness string"


def transform(labels: frozenset, remove, add) -> frozenset:
    """A specific sanitizer takes its kind away and marks generic taint as neutralised for it."""
    remove = set(remove if remove is not None else ())
    out = set(labels) - remove
    if "generic" in labels and "generic" not in remove:
        out |= {f"neutralized:{k}" for k in remove}
    return frozenset(out | set(add if add is not None else ()))


def live(labels: frozenset, kind: str) -> bool:
    kind = (kind or "").strip() or "generic"
    some = {k for k in labels if not k.startswith("neutralized:")}
    return kind in some or "generic" in some and f"neutralized:{kind}" not in labels or kind == "generic" and bool(some)


def witness(edges: dict, source: int, kind: str, sink: int, sink_kind: str, states: int = STATES, calls: int = 8) -> tuple[list[int] | None, str]:
    """A shortest way on which labels stay live and calls return to their sites; and the completeness of the search.
    edges: node -> [(dst, kind, site, remove, add)]."""
    start = (source, frozenset([(kind or "").strip() or "generic"]), (), False)
    before, queue, state = {start: None}, deque([start]), "complete"
    while queue:
        at = queue.popleft()
        node, labels, stack, cut = at
        if node == sink and live(labels, sink_kind):
            path = []
            while at:
                path.append(at[0])
                at = before[at]
            return path[::-1], state
        for dst, how, site, remove, add in edges.get(node, ()):
            after, short = stack, cut
            if how == "enter":
                after = (*stack, site)
                if len(after) > calls:
                    after, short, state = after[-calls:], True, "context_limit"
            elif how == "leave" and stack:
                if stack[-1] != site:
                    continue
                after = stack[:-1]
            kept = transform(labels, remove, add)
            if not any(not k.startswith("neutralized:") for k in kept):
                continue
            new = (dst, kept, after, short)
            if new not in before:
                if len(before) >= states:
                    return None, "visit_limit"
                before[new] = at
                queue.append(new)
    return None, state


def findings(flow_edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 96, limit: int = FINDINGS) -> DataFrame:
    """Findings in the order of their sources and sinks, each source rule once for each sink and rule. At most `limit`; if
    there are more, a last row RESULT_LIMIT without path says so."""
    spark = flow_edges.sparkSession
    ship(spark)
    calls = min(max(max_depth, 8), 32)  # sites that a search's stack holds
    plain = flow_edges.select("src", "dst")
    inside = written(graph.slice_between(plain, sources.select("node"), sinks.select("node"), max_depth).select("node"), "slice")
    keep = lambda c: inside.select(F.col("node").alias(c))
    edges = written(flow_edges.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi"), "sliced")
    hit = written(sinks.join(inside, "node", "left_semi"), "sinks")
    # what reaches each sink: (sink, node), so a task gets the edges of its own slice only
    back = written(graph.propagate(hit.select("node", F.col("node").alias("fact")), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "backward")
    own = back.withColumnRenamed("fact", "sink_node")
    parts = own.join(edges.withColumnRenamed("src", "node"), "node").withColumnRenamed("node", "src")
    to = own.select("sink_node", F.col("node").alias("dst"))
    parts = parts.join(to, ["sink_node", "dst"], "left_semi")
    where = hit.select(F.col("node").alias("sink_node"), F.col("rule_id").alias("sink_rule_id"), F.col("kind").alias("sink_kind"), "location")
    nothing = F.lit(None)
    edge_rows = where.join(parts, "sink_node").select("sink_rule_id", "sink_kind", "location", "sink_node", F.lit("edge").alias("what"), "src", "dst", "kind", "site", "remove", "add")
    source_rows = where.join(own.join(sources, "node"), "sink_node").select("sink_rule_id", "sink_kind", "location", "sink_node", F.lit("source").alias("what"), F.col("node").alias("src"), nothing.cast("long").alias("dst"), "kind", nothing.cast("long").alias("site"), nothing.cast("array<string>").alias("remove"), F.array("rule_id").alias("add"))

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        out, reported = [], set()
        for sink, own_rows in rows.groupby("sink_node", sort=True):
            edges, failed = {}, 0
            at = own_rows[own_rows.what == "edge"].sort_values(["src", "dst", "kind"])
            for r in at.itertuples():
                edges.setdefault(r.src, []).append((int(r.dst), r.kind, r.site, r.remove, r.add))
            first = own_rows.iloc[0]
            for r in own_rows[own_rows.what == "source"].sort_values(["src", "kind"]).itertuples():
                rule = r.add[0]
                if (sink, rule) in reported or failed >= FAILURES:
                    continue
                path, state = witness(edges, int(r.src), r.kind, int(sink), first.sink_kind, calls=calls)
                if path is None:
                    failed += EXHAUSTED if state == "visit_limit" else 1
                    continue
                reported.add((sink, rule))
                out.append((rule, first.sink_rule_id, r.kind, first.sink_kind, int(r.src), int(sink), first.location, path, state))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FINDING_DDL.split(", ")])

    found = edge_rows.unionByName(source_rows).groupBy("sink_rule_id", "location").applyInPandas(search, FINDING_DDL)
    return limited(found, limit)


#: The parts of a search state besides its source: where it is, what it carries, and the call sites that it is within.
_STATE = ["node", "labels", "stack", "cut"]
ROUNDS = 10_000


def _moved(at: DataFrame, edges: DataFrame, keep: list[str], calls: int) -> DataFrame:
    """States a step on along edges(node, next, kind, site, remove, add): labels transformed, dead states dropped, sites pushed
    where a call is entered and taken off where it is left, which only its own site may do."""
    on = at.join(edges, "node")
    enter, leave = F.col("kind") == "enter", F.col("kind") == "leave"
    last, deep = F.try_element_at("stack", F.lit(-1)), F.size("stack") >= calls
    on = on.where(~leave | last.isNull() | (last == F.col("site")))
    pushed, again = F.concat("stack", F.array("site")), F.array_position("stack", F.col("site"))
    # a site that is entered within itself is the same one again, so recursion has an end
    stack = F.when(enter & (again > 0), F.slice("stack", F.lit(1), again.cast("int"))).when(enter, F.when(deep, F.slice(pushed, 2, calls)).otherwise(pushed)).when(leave & last.isNotNull(), F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0)))).otherwise(F.col("stack"))
    nothing = F.array().cast("array<string>")
    labels = risk.apply_labels(F.col("labels"), F.coalesce("remove", nothing), F.coalesce("add", nothing))
    out = on.select(*keep, F.col("next").alias("node"), labels.alias("labels"), stack.alias("stack"), (F.col("cut") | enter & (deep | (again > 0))).alias("cut"))
    return out.where(F.exists("labels", lambda k: ~F.startswith(k, F.lit("neutralized:"))))


def _kind(c) -> Column:
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "generic").otherwise(F.trim(c))


def search(flow_edges: DataFrame, sources: DataFrame, sinks: DataFrame, max_depth: int = 96, limit: int | None = FINDINGS) -> DataFrame:
    """What findings() gives, searched for all sinks at once by joins, without a budget of states or attempts, so a sink is never
    given up; for programs with many call sites that call each other in circles there can be too many strings of sites, and
    findings() has an end. Each source rule once for each sink, from its first source from which there is a way, along the shortest way,
    of several the one whose nodes come first.

    First every state (rule, node, labels, sites) learns the first source that reaches it; a state is joined again only when
    it has learnt of an earlier one, and there are as many states as rules tell apart, not as sources or sinks. What sinks
    have learnt are the findings. Then the sources that are in one walk again, layer by layer, until their sinks are met; a
    state keeps its smallest way. limit: None for all findings, however many."""
    calls = min(max(max_depth, 8), 32)
    inside = written(graph.slice_between(flow_edges.select("src", "dst"), sources.select("node"), sinks.select("node"), max_depth).select("node"), "slice")
    keep = lambda c: inside.select(F.col("node").alias(c))
    edges = flow_edges.join(keep("src"), "src", "left_semi").join(keep("dst"), "dst", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("next"), "kind", "site", "remove", "add")
    edges = written(edges.distinct(), "sliced")
    ends = written(sinks.join(inside, "node", "left_semi").select("node", F.col("rule_id").alias("sink_rule_id"), F.col("kind").alias("sink_kind"), "location").distinct(), "sinks")
    site = edges.schema["site"].dataType.simpleString()
    start = sources.join(inside, "node", "left_semi").select("rule_id", F.struct("node", "kind").alias("first"), "node", F.array(_kind(F.col("kind"))).alias("labels"), F.array().cast(f"array<{site}>").alias("stack"), F.lit(False).alias("cut"))
    start = written(start.distinct(), "starts")

    state = ["rule_id", *_STATE]
    known = written(start.groupBy(*state).agg(F.min("first").alias("first")), "states")
    new = known
    for _ in range(ROUNDS):
        on = _moved(new, edges, ["rule_id", "first"], calls).groupBy(*state).agg(F.min("first").alias("first"))
        better = on.join(known.withColumnRenamed("first", "before"), state, "left").where("before is null or first < before").select(*state, "first")
        new = written(better, "states")
        if new.isEmpty():
            break
        known = written(known.unionByName(new).groupBy(*state).agg(F.min("first").alias("first")), "states")
    else:
        raise RuntimeError(f"states still change after {ROUNDS} rounds")
    met = known.join(ends, "node").where(risk.live_for(F.col("labels"), _kind(F.col("sink_kind"))))
    goals = met.groupBy("rule_id", "node", "sink_rule_id", "sink_kind", "location").agg(F.min("first").alias("first"))
    goals = written(goals.withColumnRenamed("node", "sink"), "goals")

    own = ["rule_id", "first"]
    open_ = goals
    layer = start.join(goals.select(*own).distinct(), own, "left_semi").withColumn("path", F.array("node"))
    layer = written(layer.groupBy(*own, *_STATE).agg(F.min("path").alias("path")), "layer")
    seen, found = layer.select(*own, *_STATE), None
    for _ in range(ROUNDS):
        at = layer.join(open_, (layer["rule_id"] == open_["rule_id"]) & (layer["first"] == open_["first"]) & (layer["node"] == open_["sink"])).where(risk.live_for(layer["labels"], _kind(open_["sink_kind"])))
        at = at.select(*(open_[c] for c in goals.columns), "path", "cut").groupBy(*goals.columns).agg(F.min(F.struct("path", "cut")).alias("way"))
        at = written(at, "met")
        found = at if found is None else found.unionByName(at)
        open_ = written(open_.join(at, goals.columns, "left_anti"), "open")
        if open_.isEmpty():
            break
        on = _moved(layer.join(open_.select(*own).distinct(), own, "left_semi"), edges, [*own, "path"], calls).join(seen, [*own, *_STATE], "left_anti")
        layer = written(on.withColumn("path", F.concat("path", F.array("node"))).groupBy(*own, *_STATE).agg(F.min("path").alias("path")), "layer")
        seen = seen.unionByName(layer.select(*own, *_STATE))
    out = found.select(
        F.col("rule_id").alias("source_rule_id"), "sink_rule_id", F.col("first.kind").alias("source_kind"), "sink_kind", F.col("first.node").alias("source_node"), F.col("sink").alias("sink_node"),
        "location", F.col("way.path").alias("path"), F.when(F.col("way.cut"), "context_limit").otherwise("complete").alias("completeness"),
    )
    return out if limit is None else limited(out, limit)


def limited(found: DataFrame, limit: int) -> DataFrame:
    """The first `limit` findings, and in the place of the next one, if there is one, the limit row."""
    order = ["source_node", "sink_node", "source_rule_id", "sink_rule_id", "location"]
    first = found.orderBy(*order).limit(limit + 1).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # limit + 1 rows in one task
    told = {"source_rule_id": F.lit(RESULT_LIMIT), "sink_rule_id": F.lit(RESULT_LIMIT), "source_kind": F.lit(LIMIT_KIND), "sink_kind": F.lit(LIMIT_KIND), "source_node": F.lit(0).cast("long"), "sink_node": F.lit(0).cast("long"), "location": F.lit("@analysis"), "path": F.array().cast("array<long>"), "completeness": F.lit("visit_limit")}
    return first.orderBy("place").select(*(F.when(F.col("place") > limit, told[c]).otherwise(F.col(c)).alias(c) for c in found.columns))


def steps(found: DataFrame) -> DataFrame:
    """(source_rule_id, sink_rule_id, sink_node, step, node) of each finding's path."""
    return found.select("source_rule_id", "sink_rule_id", "sink_node", F.posexplode("path").alias("step", "node"))


def kind_closure(transforms: DataFrame, rounds: int = 100) -> DataFrame:
    """(kind, becomes) of transforms(a, b): the kinds that a kind can become by any transforms, wherever they stand, itself
    included.

    Kinds that nothing becomes aren't walked from: those with the same next kinds become the same, which is put together once
    from the closure of the other kinds and joined to them, without a shuffle where it is small."""
    known = transforms.select("a", "b")
    inner = written(known.where("b is not null").select(F.col("b").alias("k")).distinct(), "kinds")
    firsts = known.where("a is not null").join(inner.withColumnRenamed("k", "a"), "a", "left_anti")
    firsts = written(firsts.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("next")), "firsts")
    between = known.where("a is not null and b is not null").join(inner.withColumnRenamed("k", "a"), "a", "left_semi")
    same = inner.select(F.col("k").alias("sub"), F.col("k").alias("super"), F.lit(0).alias("steps"))
    found = graph.pairs_within(same, between.select(F.col("a").alias("src"), F.col("b").alias("dst")), rounds).select(F.col("sub").alias("kind"), F.col("super").alias("becomes"))
    sets = firsts.select("next").distinct().select("next", F.explode("next").alias("kind")).join(found, "kind").select("next", "becomes").distinct()
    beyond = firsts.join(small(written(sets, "sets")), "next").select(F.col("a").alias("kind"), "becomes")
    out = found.unionByName(beyond).unionByName(firsts.select(F.col("a").alias("kind"), F.col("a").alias("becomes")))
    lost = known.where("a is not null and b is null").select(F.col("a").alias("becomes")).distinct()  # becomes what isn't known
    if lost.isEmpty():
        return out
    return out.unionByName(out.join(lost, "becomes", "left_semi").select("kind", F.lit(None).alias("becomes")).distinct())


#: Depth and visits of the four query profiles, backward; the light one is smaller forward.
BUDGETS = {"light": (48, 8192), "standard": (96, 32_768), "deep": (128, 49_152), "exhaustive": (160, 65_536)}
LIGHT_FORWARD = (40, 4096)


def plan_query(nodes: int, edges: int, backward: bool, condensed: bool, profile: str | None = None) -> dict:
    """Engine and budget of a query: condensed reachability where components are known, else the plain walk."""
    profile = profile or ("light" if nodes < 2_000 else "standard" if nodes < 20_000 else "deep" if edges < 500_000 else "exhaustive")
    depth, visits = LIGHT_FORWARD if profile == "light" and not backward else BUDGETS[profile]
    return {"engine": "condensed" if condensed else "sparse", "profile": profile, "max_depth": depth, "max_visits": visits}


def fold_by_location(found: DataFrame) -> DataFrame:
    """Findings (location, cwe array, ordinal) at one location whose weaknesses overlap, or of which one has none, fold into
    the first that fits, in their order. The rows of a location stream by; what it has become is held."""
    ship(found.sparkSession)

    def fold(batches):
        at, kept = None, []
        done = lambda rows: pd.DataFrame([(a, sorted(b), c, d) for a, b, c, d in rows], columns=["location", "cwe", "ordinal", "merged"])
        for frame in batches:
            out = []
            for r in frame.itertuples(index=False):
                if r.location != at:
                    out += kept
                    at, kept = r.location, []
                cwe = set(r.cwe if r.cwe is not None else ())
                into = next((k for k in kept if not k[1] or not cwe or k[1] & cwe), None)
                if into:
                    into[1] |= cwe
                    into[3] += 1
                else:
                    kept.append([r.location, cwe, r.ordinal, 1])
            if out:
                yield done(out)
        if kept:
            yield done(kept)

    rows = found.select("location", "cwe", "ordinal").repartition("location").sortWithinPartitions("location", "ordinal")
    return rows.mapInPandas(fold, "location string, cwe array<string>, ordinal long, merged int")
