"""Facts about calls, functions and types: resolution, bindings, hierarchies, order within a function.

Every operator is a join on a key that the facts share, an aggregation, or a closure by semi-naive rounds; names are
exploded into the keys that they can be found under, so nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.rows import first_wins, ranked
from factloom.session import broadcast_parts, small


# --- names -----------------------------------------------------------------------------------------------------------
def candidate_names(name: Column, separator: str = ".") -> Column:
    """A qualified name and all its suffixes, longest first: the names under which a call may mean it."""
    parts = F.split(name, rf"\Q{separator}\E")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), separator))


def resolve(calls: DataFrame, functions: DataFrame, limit: int) -> DataFrame:
    """calls(call, name, arity) with the functions(function, qualified, params, score) that they may mean: any suffix of the
    qualified name is the call's name. An arity that fits goes before one that doesn't, then the higher score, then the
    name; up to `limit` places a call. Of the functions of one name and number of parameters no call can place more than the
    first `limit`, so calls meet these only, however many share a name."""
    keys = functions.select("function", "qualified", "params", "score", F.explode(candidate_names(F.col("qualified"))).alias("name"))
    keys = ranked(keys, ["name", "params"], [F.desc("score"), F.asc("qualified"), F.asc("function")], limit).drop("place")
    met = calls.join(keys, "name")
    fits = (F.col("arity") == F.col("params")).cast("int")
    return ranked(met.withColumn("fits", fits), ["call"], [F.desc("fits"), F.desc("score"), F.asc("qualified"), F.asc("function")], limit).select("call", "function", "fits", "place")


def dynamic_calls(callees: DataFrame, functions: DataFrame, edges: DataFrame) -> DataFrame:
    """(call, function): function values functions(node, function) that flow along edges(src, dst) to the value
    callees(call, node) that a call runs."""
    reached = graph.propagate(functions.select("node", F.col("function").alias("fact")), edges)
    return callees.join(reached, "node").select("call", F.col("fact").alias("function")).distinct()


# --- matchers over definitions and accesses ----------------------------------------------------------------------------
def field_matches(accesses: DataFrame, rules: DataFrame) -> DataFrame:
    """accesses(access, field, owners) x rules(rule_id, field, owner, owner_regex), few rules: the field is the rule's or the
    rule's is '*', and some owner type is the rule's or fits its pattern. A rule without owner and pattern takes any owner;
    one with either never matches an access whose owners aren't known."""
    some = lambda test: F.exists("owners", test)
    owner = F.coalesce(some(lambda t: t == F.col("owner")), F.lit(False)) | F.coalesce(some(lambda t: F.regexp_like(t, F.col("owner_regex"))), F.lit(False))
    holds = (F.col("owner").isNull() & F.col("owner_regex").isNull()) | owner
    out = accesses.join(small(rules.where("field <> '*'")), "field").where(holds).select("access", "rule_id")
    for part in broadcast_parts(rules.where("field = '*'").drop("field")):
        out = out.unionByName(accesses.join(part, holds).select("access", "rule_id"))
    return out


def function_matches(functions: DataFrame, rules: DataFrame) -> DataFrame:
    """functions(function, name, params) x rules(rule_id, exact, contains, regex, params), few rules; what a rule leaves NULL
    it doesn't ask for."""
    f = functions.withColumnRenamed("params", "own_params")
    asks = lambda c, test: F.col(c).isNull() | F.coalesce(test, F.lit(False))
    holds = asks("contains", F.contains("name", "contains")) & asks("regex", F.regexp_like("name", F.col("regex"))) & asks("params", F.col("own_params") == F.col("params"))
    out = f.join(small(rules.where("exact is not null")), F.col("name") == F.col("exact")).where(holds).select("function", "rule_id")
    for part in broadcast_parts(rules.where("exact is null")):
        out = out.unionByName(f.join(part, holds).select("function", "rule_id"))
    return out


def by_callee(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls(call, callee) that rules(rule_id, callees) name: an inverted index from each callee to its rules."""
    index = rules.select("rule_id", F.explode(F.array_distinct("callees")).alias("callee"))
    return calls.join(index, "callee").select("call", "rule_id")


# --- bindings ----------------------------------------------------------------------------------------------------------
def bind(actuals: DataFrame, formals: DataFrame, order: str | None = None) -> DataFrame:
    """(call, function, formal, value, how) of actuals(call, function, place, name, value) and formals(function, formal,
    place, name, rest, default): by name, else by place, else into the rest parameter, else the default. One row a formal,
    but for the rest parameter, which takes all that is left. order: a column of actuals; of those at one place the first
    in this order is taken."""
    said = [F.col(order).alias("said")] if order else []
    of = formals.select("function", "formal", F.col("place").alias("f_place"), F.col("name").alias("f_name"), "rest")
    named = actuals.where("name is not null").join(of.where("not rest"), (actuals["name"] == F.col("f_name")) & (actuals["function"] == of["function"]))
    placed = actuals.where("name is null").join(of.where("not rest"), (actuals["place"] == F.col("f_place")) & (actuals["function"] == of["function"]))
    pick = lambda rows, how: rows.select("call", actuals["function"], "formal", "value", F.lit(how).alias("how"), actuals["place"].alias("place"), *said)
    both = pick(named, 0).unionByName(pick(placed, 1)).withColumn("order", F.struct("how", "place", *(["said"] if order else [])))
    bound = first_wins(both, ["call", "formal"], "order").select("call", "function", "formal", "value", "how")
    last = formals.where("not rest").groupBy("function").agg(F.max("place").alias("last"))
    extra = actuals.where("name is null").join(last, "function", "left").where(F.coalesce(F.col("place") > F.col("last"), F.lit(True)))
    extra = extra.join(formals.where("rest").select("function", "formal"), "function").select("call", "function", "formal", "value", F.lit(2).alias("how"))
    open_ = actuals.select("call", "function").distinct().join(formals.where("not rest and default is not null").select("function", "formal", F.col("default").alias("value")), "function")
    open_ = open_.join(bound.select("call", "formal"), ["call", "formal"], "left_anti").select("call", "function", "formal", "value", F.lit(3).alias("how"))
    return bound.unionByName(extra).unionByName(open_)


def unused_returns(calls: DataFrame, uses: DataFrame) -> DataFrame:
    """calls(func, value, ...) whose result no row of uses(func, value) reads."""
    return calls.join(uses.select("func", "value"), ["func", "value"], "left_anti")


# --- hierarchies -------------------------------------------------------------------------------------------------------
def closure(edges: DataFrame, depth: int = 64) -> DataFrame:
    """(sub, super, steps) of edges(sub, super): every type with itself and all its supertypes, by a shortest way. Types in a
    circle are each other's supertypes."""
    direct = edges.select(F.col("sub").alias("src"), F.col("super").alias("dst"))
    names = direct.select("src").union(direct.select("dst")).distinct()
    pairs = names.select(F.col("src").alias("sub"), F.col("src").alias("super"), F.lit(0).alias("steps"))
    return graph.pairs_within(pairs, direct, depth)


def members(types: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """types(..., sub) at each of their supertypes of closure(): (..., super)."""
    return types.join(hierarchy.select("sub", "super"), "sub").drop("sub")


# --- order -------------------------------------------------------------------------------------------------------------
def prior_match(key: str, order: str, matches: Column) -> Column:
    """The place of the latest earlier row of the same key that matches; NULL where there is none."""
    return F.max(F.when(matches, F.col(order))).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def is_last(key: str, order: str) -> Column:
    """Whether a row is the last of its key."""
    return F.lead(F.lit(1)).over(Window.partitionBy(key).orderBy(order)).isNull()


def temporally_feasible(events: DataFrame, key: str, order: str, source: Column, sink: Column) -> DataFrame:
    """(key, feasible): whether some source event may come before some sink event. A key without one of them is feasible, as
    nothing is known. An aggregate, so a hot key moves one row a task."""
    return events.groupBy(key).agg(F.coalesce(F.min(F.when(source, F.col(order))) < F.max(F.when(sink, F.col(order))), F.lit(True)).alias("feasible"))


# --- imports -----------------------------------------------------------------------------------------------------------
def module_imports(imports: DataFrame, modules: DataFrame, separator: str = ".") -> DataFrame:
    """imports(file, name) with the package of modules(package, module) that has the longest module that is a prefix of the
    name at a separator."""
    parts = F.split("name", rf"\Q{separator}\E")
    keys = imports.select("file", "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), separator))).alias("module"))
    met = keys.join(modules, "module").withColumn("order", F.struct(-F.length("module"), F.col("package")))
    return first_wins(met.select("file", "name", "package", "module", "order"), ["file", "name"], "order").drop("order")


def unreported(misuse: DataFrame, taint: DataFrame) -> DataFrame:
    """misuse(id, path, line, cwe) that no taint finding (path, line, cwe) at the same place with a common weakness reports."""
    told = taint.select("path", "line", F.explode("cwe").alias("c")).distinct()
    seen = misuse.select("id", "path", "line", F.explode("cwe").alias("c")).join(told, ["path", "line", "c"], "left_semi").select("id").distinct()
    return misuse.join(seen, "id", "left_anti")


# --- programs ----------------------------------------------------------------------------------------------------------
def union_programs(functions: list[DataFrame], edges: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Programs functions(id, name) with call edges(src, dst) side by side: the ids of each are moved past those of the ones
    before it. Returns both with the number of the program."""
    all_functions = all_edges = None
    offset = 0
    for n, (f, e) in enumerate(zip(functions, edges, strict=True)):
        moved = lambda c: (F.col(c) + F.lit(offset)).alias(c)  # noqa: B023, E731
        own, links = f.select(F.lit(n).alias("program"), moved("id"), "name"), e.select(F.lit(n).alias("program"), moved("src"), moved("dst"))
        all_functions = own if all_functions is None else all_functions.unionByName(own)
        all_edges = links if all_edges is None else all_edges.unionByName(links)
        if n + 1 < len(functions):
            offset += (f.agg(F.max("id")).first()[0] or 0) + 1
    return all_functions, all_edges
