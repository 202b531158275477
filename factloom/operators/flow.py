"""Building flow graphs from matches: ports, synthetic source and sink nodes, summaries, captures, container and result models.

Rules and models are small tables of configuration; facts meet them on equal keys. Nodes are structs of their parts, so no
counter has to be handed out: the same fact gives the same node wherever it is built.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph, matching
from factloom.session import broadcast_parts, ship, small, written

#: How methods of containers move values between ports.
CONTAINERS = [
    ("append", "arg0", "receiver"), ("add", "arg0", "receiver"), ("push", "arg0", "receiver"), ("extend", "arg0", "receiver"), ("update", "arg0", "receiver"), ("insert", "arg1", "receiver"),
    ("setdefault", "arg1", "receiver"), ("setdefault", "arg1", "return"), ("get", "receiver", "return"), ("pop", "receiver", "return"), ("items", "receiver", "return"), ("values", "receiver", "return"), ("copy", "receiver", "return"), ("join", "arg0", "return"),
]
#: What language-level calls pass on.
INTRINSICS = [("python", "str", "arg0", "return"), ("python", "list", "arg0", "return"), ("python", "dict", "arg0", "return"), ("python", "format", "arg0", "return"), ("go", "append", "arg0", "return"), ("go", "append", "arg1", "return"), ("javascript", "String", "arg0", "return"), ("rust", "Some", "arg0", "return")]


def node(kind: str, *parts: Column) -> Column:
    """A node's name: its kind and what tells it from others of the kind."""
    return F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))


def port_node(call: Column, port: Column) -> Column:
    return node("port", call, port)


def call_ports(calls: DataFrame, arguments: DataFrame) -> DataFrame:
    """(src, dst, kind) of calls(call, result, receiver) and arguments(call, place, value): values flow into argument and
    receiver ports, the return port flows into the result."""
    value = lambda c: node("value", F.col(c))
    call = F.col("call")
    into = arguments.select(value("value").alias("src"), port_node(call, F.concat(F.lit("arg"), F.col("place").cast("string"))).alias("dst"), F.lit("argument").alias("kind"))
    receiver = calls.where("receiver is not null").select(value("receiver").alias("src"), port_node(call, F.lit("receiver")).alias("dst"), F.lit("receiver").alias("kind"))
    result = calls.where("result is not null").select(port_node(call, F.lit("return")).alias("src"), value("result").alias("dst"), F.lit("result").alias("kind"))
    return into.unionByName(receiver).unionByName(result)


def call_edges(bindings: DataFrame, returns: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, kind, site): bound arguments of bindings(call, formal, value) enter a function; returns(function, value) leave
    it to the result ports of targets(call, function)."""
    enter = bindings.select(node("value", F.col("value")).alias("src"), node("formal", F.col("formal")).alias("dst"), F.lit("enter").alias("kind"), F.col("call").alias("site"))
    leave = returns.join(targets, "function").select(node("value", F.col("value")).alias("src"), port_node(F.col("call"), F.lit("return")).alias("dst"), F.lit("leave").alias("kind"), F.col("call").alias("site"))
    return enter.unionByName(leave)


def seeds(matches: DataFrame, ports: DataFrame, what: str) -> DataFrame:
    """Synthetic nodes (node, port, rule_id, kind) of matches(call, arity, rule_id) and the ports(rule_id, port, kind) of their
    rules, variadic ports expanded; what: source or sink."""
    met = matches.join(small(ports), "rule_id").select("call", "rule_id", "kind", F.explode(matching.expand_ports(F.col("port"), F.col("arity"))).alias("port"))
    return met.select(node(what, F.col("call"), F.col("rule_id"), F.col("port")).alias("node"), port_node(F.col("call"), F.col("port")).alias("port"), "rule_id", F.coalesce(F.nullif("kind", F.lit("")), F.lit("generic")).alias("kind"))


def field_nodes(matches: DataFrame, accesses: DataFrame, rules: DataFrame, what: str) -> DataFrame:
    """(node, value, rule_id, kind): synthetic nodes of matches(access, rule_id) between rules(rule_id, kind) and the value that
    accesses(access, field, value) read (what: source) or write (what: sink)."""
    met = matches.join(small(rules), "rule_id").join(accesses, "access")
    return met.select(node(what, F.col("access"), F.col("rule_id"), F.concat(F.lit("member="), "field")).alias("node"), node("value", F.col("value")).alias("value"), "rule_id", F.coalesce(F.nullif("kind", F.lit("")), F.lit("generic")).alias("kind"))


def index_sinks(accesses: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, value, rule_id, kind) of indices that are computed: accesses(access, language, base_name, index, is_load, constant)
    x rules(rule_id, language, kind, on_load, on_store, base_regex, direct_only), few rules. A rule without language takes any;
    one with a pattern needs a base with a name; one that is direct_only leaves out indices with a known constant. on_store
    is true and on_load false where they are null."""
    way = F.when(F.col("is_load"), F.coalesce("on_load", F.lit(False))).otherwise(F.coalesce("on_store", F.lit(True)))
    name = F.col("base_regex").isNull() | F.coalesce(F.regexp_like("base_name", F.col("base_regex")), F.lit(False))
    direct = ~F.coalesce("direct_only", F.lit(False)) | F.col("constant").isNull()
    holds = way & name & direct & (F.col("r_language").isNull() | F.coalesce(F.col("language") == F.col("r_language"), F.lit(False)))
    out = None
    for part in broadcast_parts(rules.withColumnRenamed("language", "r_language")):
        met = accesses.join(part, holds)
        met = met.select(node("sink", F.col("access"), F.col("rule_id"), F.lit("index")).alias("node"), node("value", F.col("index")).alias("value"), "rule_id", F.coalesce(F.nullif("kind", F.lit("")), F.lit("generic")).alias("kind"))
        out = met if out is None else out.unionByName(met)
    return out


def function_nodes(matches: DataFrame, functions: DataFrame, ports: DataFrame, what: str) -> DataFrame:
    """(node, port, rule_id, kind) of matched definitions: matches(function, rule_id), functions(function, params, receiver) with
    the number of all parameters and whether the first is the receiver, ports(rule_id, port, kind). Ports of arguments count
    without the receiver and are left out where the function has no such parameter."""
    shift = F.col("receiver").cast("int")
    met = matches.join(functions, "function").join(small(ports), "rule_id")
    met = met.select("function", "rule_id", "kind", "params", "receiver", shift.alias("shift"), F.explode(matching.expand_ports(F.col("port"), F.greatest(F.col("params") - shift, F.lit(0)))).alias("port"))
    nth = F.regexp_extract("port", r"^arg(\d+)$", 1).try_cast("int") + F.col("shift")
    formal = lambda k: node("formal", F.col("function"), k)
    to = F.when(F.col("port") == "return", node("return", F.col("function"))).when((F.col("port") == "receiver") & F.col("receiver"), formal(F.lit(0))).when(nth < F.col("params"), formal(nth))
    found = met.select(node(what, F.col("function"), F.col("rule_id"), F.col("port")).alias("node"), to.alias("port"), "rule_id", F.coalesce(F.nullif("kind", F.lit("")), F.lit("generic")).alias("kind"))
    return found.where("port is not null").distinct()


#: Ports whose value can be written back to.
WRITABLE = r"^(receiver|arg\d+|named:.*)$"


def summaries(matches: DataFrame, flows: DataFrame) -> DataFrame:
    """(src, dst, rule_id, back) of matches(call, arity, rule_id) and flows(rule_id, inp, outp): each input port, expanded, to
    each output port, expanded, but not to itself. back: what is written there also changes the value behind the port."""
    met = matches.join(small(flows), "rule_id")
    wide = met.select("call", "arity", "rule_id", "outp", F.explode(matching.expand_ports(F.col("inp"), F.col("arity"))).alias("i")).select("call", "rule_id", "i", F.explode(matching.expand_ports(F.col("outp"), F.col("arity"))).alias("o"))
    return wide.where("i <> o").select(port_node(F.col("call"), F.col("i")).alias("src"), port_node(F.col("call"), F.col("o")).alias("dst"), "rule_id", F.col("o").rlike(WRITABLE).alias("back")).distinct()


def modelled(calls: DataFrame, spark) -> DataFrame:
    """(call, src, dst): flows of container methods and language-level calls of calls(call, language, method)."""
    containers = spark.createDataFrame(CONTAINERS, "method string, i string, o string")
    intrinsics = spark.createDataFrame(INTRINSICS, "language string, method string, i string, o string")
    flows = calls.join(F.broadcast(containers), "method").select("call", "i", "o").unionByName(calls.join(F.broadcast(intrinsics), ["language", "method"]).select("call", "i", "o"))
    return flows.select("call", port_node(F.col("call"), F.col("i")).alias("src"), port_node(F.col("call"), F.col("o")).alias("dst")).distinct()


def captures(lambdas: DataFrame, scopes: DataFrame) -> DataFrame:
    """(lambda, name, value): free names of lambdas(lambda, func, at, names) bound to the last value before it that
    scopes(func, at, name, value) gives the name in the function around it."""
    free = lambdas.select("lambda", "func", F.col("at").alias("until"), F.explode(F.array_distinct("names")).alias("name"))
    met = free.join(scopes, ["func", "name"]).where("at < until")
    return met.groupBy("lambda", "name").agg(F.max_by("value", "at").alias("value"))


def named_sources(values: DataFrame, names: DataFrame) -> DataFrame:
    """values(value, name) that a rule of names(rule_id, name) takes as sources, few rules."""
    return values.join(small(names), "name").select("value", "rule_id")


def return_types(calls: DataFrame, known: DataFrame) -> DataFrame:
    """calls(call, callee, result_type) with the type of their result: what the code says, else what known(callee, type) says of
    the callee, else of its last name."""
    last = F.element_at(F.split("callee", r"\."), -1)
    by = lambda name, alias: known.select(F.col("callee").alias(name), F.col("type").alias(alias))
    out = calls.withColumn("simple", last).join(small(by("callee", "full")), "callee", "left").join(small(by("simple", "short")), "simple", "left")
    return out.select("call", F.coalesce("result_type", "full", "short").alias("type"))


def case_breaks(cases: DataFrame, ends: DataFrame, accepted: tuple[str, ...] = ("break", "return", "throw", "continue", "goto")) -> DataFrame:
    """cases(func, switch, nth, block) whose block no accepted end of ends(func, block, kind) closes, but for the last case of
    its switch."""
    last = cases.groupBy("func", "switch").agg(F.max("nth").alias("last"))
    closed = ends.where(F.col("kind").isin(*accepted)).select("func", "block")
    return cases.join(last, ["func", "switch"]).where("nth < last").drop("last").join(closed, ["func", "block"], "left_anti").select("func", "switch", "nth", "block")


def described(nodes: DataFrame, places: DataFrame) -> DataFrame:
    """(node, label, location) of nodes(node, kind, name) and places(node, path, line); a node without a place has none."""
    label = F.format_string("%s %s", F.col("kind"), F.coalesce("name", F.lit("?")))
    return nodes.join(places, "node", "left").select("node", label.alias("label"), F.when(F.col("path").isNotNull(), F.format_string("%s:%d", "path", "line")).alias("location"))


def reconstructed(pieces: DataFrame) -> DataFrame:
    """(value, text) of pieces(value, place, literal): literals one after the other, '{}' for what isn't known, as URLs and SQL
    are read from code."""
    parts = F.array_sort(F.collect_list(F.struct("place", F.coalesce("literal", F.lit("{}")).alias("t"))))
    return pieces.groupBy("value").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias("text"))


def diagnostics(problems: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of problems(func, value, problem) whose rule of rules(problem, rule_id, enabled) is on."""
    return problems.join(small(rules.where("enabled")), "problem").select("rule_id", "func", "value")


def boundary_rules(mappings: DataFrame) -> DataFrame:
    """(rule_id, family, callee, port) of mappings(boundary, producer, consumer): what reaches the producer's first argument is
    a sink, what the consumer gets a source."""
    rule = lambda family, callee, port: F.struct(F.concat_ws("-", F.lit(family), F.col("boundary")).alias("rule_id"), F.lit(family).alias("family"), F.col(callee).alias("callee"), F.lit(port).alias("port"))
    return mappings.select(F.explode(F.array(rule("sink", "producer", "arg0"), rule("source", "consumer", "arg0"))).alias("r")).select("r.*").where("callee is not null")


def observations(rows: DataFrame) -> DataFrame:
    """(package, ordinal, ids): observations rows(package, ids, ordinal) of a package folded in their order: one whose ids meet
    those of an entry joins the first such entry, whose ids grow by its own; else it is an entry itself.

    Entries can only meet along ids, so the connected groups of ids of a package are folded each by itself, as rows that stream
    by in order. A group's entries are held, not its rows; of rows that have the same one id only the first changes anything
    and is looked at."""
    spark = rows.sparkSession
    ship(spark)
    named = rows.select("package", "ordinal", F.array_sort(F.array_distinct("ids")).alias("ids"))
    single = named.where(F.size("ids") == 1).groupBy("package", "ids").agg(F.min("ordinal").alias("ordinal")).select(*named.columns)
    todo = written(named.where(F.size("ids") != 1).unionByName(single), "observations")
    of = lambda i: F.struct(F.col("package").alias("p"), i.alias("i"))
    links = todo.where(F.size("ids") > 0).select(of(F.col("ids")[0]).alias("src"), F.explode(F.transform("ids", of)).alias("dst"))
    groups = graph.components(links).select(F.col("node").alias("first"), F.to_json("root").alias("group"))
    met = todo.where(F.size("ids") > 0).withColumn("first", of(F.col("ids")[0])).join(groups, "first").select("group", "ordinal", "package", "ids")
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("package", "ordinal", "ids")}

    def fold(batches):
        group, held = None, []
        for frame in batches:
            done = []
            for r in frame.itertuples(index=False):
                if r.group != group:
                    done += held
                    group, held = r.group, []
                own = set(r.ids)
                into = next((e for e in held if not own.isdisjoint(e[2])), None)
                if into:
                    into[2] |= own
                else:
                    held.append([r.package, r.ordinal, own])
            if done:
                yield pd.DataFrame([(a, b, sorted(c)) for a, b, c in done], columns=["package", "ordinal", "ids"])
        if held:
            yield pd.DataFrame([(a, b, sorted(c)) for a, b, c in held], columns=["package", "ordinal", "ids"])

    folded = met.repartition("group").sortWithinPartitions("group", "ordinal").mapInPandas(fold, ", ".join(f"{c} {t}" for c, t in kind.items()))
    return folded.unionByName(todo.where(F.size("ids") == 0).select("package", "ordinal", "ids"))
