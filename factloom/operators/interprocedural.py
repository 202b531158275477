"""Flow through calls that return to where they came from: summaries of functions, reachability along matched calls, call strings.

A program is a few tables. local(func, src, dst) are flows within a function; calls(call, func, callee, result) its call sites,
`result` the node that gets what comes back (null: nothing does); actuals(call, nth, node) what is given; params(func, nth, node)
and returns(func, node) a function's ends. Nodes belong to one function each.

All facts grow by rounds that join only what the round before found with the tables, which are written once. No function and
no call graph is ever gathered; a caller is looked at again only where a callee's summary has grown.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.congruence import NotFinished
from factloom.session import Dealt, buckets, written

ROUNDS = 1000

#: Calls in a bucket: loops have many rounds, and each opens a task and files for every bucket.
CALLS = 500_000


class Program:
    """The tables of a program as loops read them, written once, rows with null ends left out. What belongs to a function is
    bucketed by it, what is given at calls by the function that is called."""

    def __init__(self, local: DataFrame, calls: DataFrame, actuals: DataFrame, params: DataFrame, returns: DataFrame):
        def keep(df: DataFrame, *columns: str) -> DataFrame:
            return df.select(*columns).where(" and ".join(f"{c} is not null" for c in columns if c != "result"))

        calls = keep(calls, "call", "func", "callee", "result")
        self.n = buckets(calls.count(), CALLS)
        dealt = lambda df, name, by: Dealt(df, name, [by], self.n).rows
        self.local = dealt(keep(local, "func", "src", "dst"), "local", "func")
        self.params, self.returns = dealt(keep(params, "func", "nth", "node"), "params", "func"), dealt(keep(returns, "func", "node"), "returns", "func")
        #: calls with what is given at them, or with nothing
        self.sites = dealt(calls.join(keep(actuals, "call", "nth", "node"), "call", "left").select("call", "func", "node", "callee", "nth", "result"), "sites", "callee")
        #: an actual of a call: (func, node) gives `nth` of callee, whose result goes to `result`
        self.given = self.sites.where("node is not null")

    @cached_property
    def enter(self) -> DataFrame:
        """Edges between functions into a parameter."""
        return self.given.join(self.params.select(F.col("func").alias("callee"), "nth", F.col("node").alias("next")), ["callee", "nth"]).select("call", "node", "next", F.col("callee").alias("to_func"))

    @cached_property
    def leave(self) -> DataFrame:
        """Edges between functions back from a return."""
        back = self.sites.where("result is not null").select("call", "callee", "func", "result").distinct().join(self.returns.select(F.col("func").alias("callee"), "node"), "callee")
        return back.select("call", "node", F.col("result").alias("next"), F.col("func").alias("to_func"))


def summaries(program: Program, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(func, nth) of the parameters that flow to what their function returns, through whatever it calls; and the edges
    (func, src, dst, call) that this gives at call sites, from an actual to the result."""
    paths, flows = tabulated(program, rounds)
    ended = paths.rows.join(program.returns, ["func", "node"], "left_semi").select("func", "nth").distinct()
    return ended, flows.rows.where("call is not null").select("func", F.col("node").alias("src"), F.col("next").alias("dst"), "call")


def tabulated(program: Program, rounds: int = ROUNDS) -> tuple[Dealt, Dealt]:
    """Path facts (func, nth, node), that a parameter reaches a node of its own function, and the flows (func, node, next, call)
    that they go along, both in buckets of functions.

    Paths grow along local edges and along summary edges; a path fact at a return is a summary, and a new summary is an edge at
    each site of its function, from which the paths that were there already go on. A round goes two steps within functions, which
    moves nothing, as each round costs the same however little it finds."""
    flows = Dealt(program.local.select("func", F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(None).cast(program.sites.schema["call"].dataType).alias("call")), "flows", ["func"], program.n)
    paths = Dealt(program.params.select("func", "nth", "node"), "paths", ["func"], program.n)
    new, step = paths.last, lambda facts, along: facts.join(along, ["func", "node"]).select("func", "nth", F.col("next").alias("node"))
    passed = program.given.where("result is not null")
    for _ in range(rounds):
        before = paths.rows
        ended = new.join(program.returns, ["func", "node"], "left_semi").select(F.col("func").alias("callee"), "nth").distinct()
        added = flows.add(passed.join(ended, ["callee", "nth"]).select("func", "node", F.col("result").alias("next"), "call"))
        on = step(new, flows.rows).unionByName(step(before, added))
        new = paths.add(on.unionByName(step(on.distinct(), flows.rows)))
        if new.isEmpty():
            return paths, flows
    raise NotFinished(f"summaries still grow after {rounds} rounds")


def reach_matched(program: Program, sources: DataFrame, edges: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(node, entered) of all nodes that sources(node) reach along ways on which every return goes back to its own call; a way
    may leave the function that it starts in, to any caller, but not one that it has entered. entered: only by ways that end
    within a call.

    With summary edges in place of calls and their returns, such a way first only leaves functions and then only enters them."""
    if edges is None:
        _, edges = summaries(program, rounds)
    flat = program.local.select("src", "dst").unionByName(edges.select("src", "dst"))
    flat = written(flat.distinct(), "flat")
    between = lambda edges: edges.select(F.col("node").alias("src"), F.col("next").alias("dst"))
    first = _reach(sources.select("node"), flat.unionByName(between(program.leave)), program.n, rounds)
    every = _reach(first, flat.unionByName(between(program.enter)), program.n, rounds)
    return every.join(first.withColumn("outside", F.lit(True)), "node", "left").select("node", F.col("outside").isNull().alias("entered"))


def _reach(start: DataFrame, edges: DataFrame, n: int, rounds: int) -> DataFrame:
    found, state = graph.reach(edges, start, rounds, buckets=n)
    if state != "complete":
        raise NotFinished(f"more is reached after {rounds} rounds")
    return found.select("node")


def reach_in_strings(program: Program, sources: DataFrame, sites: int, rounds: int = ROUNDS) -> DataFrame:
    """(node, stack, cut) of what sources(node) reach, with the call sites that a way is within, the last `sites` of them at
    most. A return goes back to the last site of its stack; one that has no site may go to any caller where the way has never
    been cut or started there. cut: the stack has lost its oldest sites, so what was reached is an upper bound.

    For few sites, or programs without deep recursion, this tells the contexts apart that a node is reached in; reach_matched
    tells exactly which nodes are reached at all."""
    call = program.sites.schema["call"].dataType
    way = lambda edges, n: edges.select("node", "next", "call", F.lit(n).alias("way"))
    local = program.local.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.lit(None).cast(call).alias("call"))
    moves = Dealt(way(local, 0).unionByName(way(program.enter, 1)).unionByName(way(program.leave, 2)), "moves", ["node"], program.n).rows
    start = sources.where("node is not null").select("node", F.array().cast(f"array<{call.simpleString()}>").alias("stack"), F.lit(False).alias("cut"))
    seen = Dealt(start, "strings", ["node"], program.n)
    last, pushed, deep = F.try_element_at("stack", F.lit(-1)), F.concat("stack", F.array("call")), F.size("stack") >= sites
    entered = F.when(deep, F.slice(pushed, 2, sites)).otherwise(pushed)
    left = F.when(last.isNull(), F.col("stack")).otherwise(F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(0))))
    stack = F.when(F.col("way") == 0, F.col("stack")).when(F.col("way") == 1, entered).otherwise(left)
    for _ in range(rounds):
        on = seen.last.join(moves, "node").where((F.col("way") < 2) | last.isNull() | (last == F.col("call")))
        if seen.add(on.select(F.col("next").alias("node"), stack.alias("stack"), (F.col("cut") | ((F.col("way") == 1) & deep)).alias("cut"))).isEmpty():
            return seen.rows
    raise NotFinished(f"more is reached after {rounds} rounds")


def heap_summaries(program: Program, stores: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(func, nth, field, from_nth): effects of functions on what they are given: what parameter `from_nth` is, or holds, ends in
    `field` of parameter `nth`, by the function itself or by one that it calls.

    stores(func, base, field, value) are writes. A write's ends are traced to parameters by the path facts of summaries(); a
    caller that gives both parameters on from its own has the effect as well."""
    paths = tabulated(program, rounds)[0].rows
    by = lambda c, nth: paths.select("func", F.col("node").alias(c), F.col("nth").alias(nth))
    known = Dealt(stores.join(by("base", "nth"), ["func", "base"]).join(by("value", "from_nth"), ["func", "value"]).select("func", "nth", "field", "from_nth"), "effects", ["func"], program.n)
    #: which parameter of a caller each parameter of a callee is, at each site
    given = Dealt(program.given.join(by("node", "own"), ["func", "node"]).select("call", "func", "callee", "nth", "own"), "passed", ["callee"], program.n).rows
    start = given.select("call", "callee", F.col("nth").alias("from_nth"), F.col("own").alias("start"))
    for _ in range(rounds):
        at = known.last.withColumnRenamed("func", "callee").join(given, ["callee", "nth"]).join(start, ["callee", "call", "from_nth"])
        if known.add(at.select("func", F.col("own").alias("nth"), "field", F.col("start").alias("from_nth"))).isEmpty():
            return known.rows
    raise NotFinished(f"effects still grow after {rounds} rounds")


def lifetime_contracts(program: Program, effects: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(func, nth, effect): what functions do to what their parameters hold: "frees", "moves" or "uses", by themselves or by what
    they call. effects(func, node, effect) are the places in a function's own code."""
    local = program.local.select("func", F.col("src").alias("node"), F.col("dst").alias("next"))
    paths = written(program.params.select("func", "nth", "node"), "paths")
    new = paths
    for _ in range(rounds):
        new = written(new.join(local, ["func", "node"]).select("func", "nth", F.col("next").alias("node")).distinct().join(paths, ["func", "nth", "node"], "left_anti"), "paths")
        if new.isEmpty():
            break
        paths = paths.unionByName(new)
    else:
        raise NotFinished(f"paths still grow after {rounds} rounds")
    known = written(effects.join(paths, ["func", "node"]).select("func", "nth", "effect").distinct(), "contracts")
    given = written(program.given.join(paths.withColumnRenamed("nth", "own"), ["func", "node"]).select("func", "callee", "nth", "own").distinct(), "passed")
    new = known
    for _ in range(rounds):
        at = new.withColumnRenamed("func", "callee").join(given, ["callee", "nth"]).select("func", F.col("own").alias("nth"), "effect")
        new = written(at.distinct().join(known, known.columns, "left_anti"), "contracts")
        if new.isEmpty():
            return known
        known = known.unionByName(new)
    raise NotFinished(f"contracts still grow after {rounds} rounds")


def contract_steps(contracts: DataFrame, calls: DataFrame, actuals: DataFrame) -> DataFrame:
    """(func, pos, node, effect): what the calls of a function do to what they give, for a walk over the function's code.
    calls(call, func, callee, pos), actuals(call, nth, node)."""
    return calls.join(actuals, "call").join(contracts.select(F.col("func").alias("callee"), "nth", "effect"), ["callee", "nth"]).select("func", "pos", "node", "effect").distinct()
