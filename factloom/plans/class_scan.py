"""From class files to findings: decoded instructions, calls to the methods that they can run, and the taint search.

A call of a method goes by a node for what is called (owner, name, descriptor), which leads to all methods that it can run:
calls and methods are never paired with each other, however many share a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import calls, containers, heap
from factloom.plans import taint_scan
from factloom.session import written
from factloom.sources import class_files

#: Beginnings of names of library methods that put their arguments into the object they are called on.
FILLERS = r"^(<init>|add|append|insert|offer|push|put|set|write|replace)"
#: Primitive types as descriptors write them.
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}


def java_types(descriptor: Column) -> Column:
    """Types of the parameters of a method descriptor, as Java source writes them."""
    parts = F.regexp_extract_all(F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1), F.lit(r"\[*(?:L[^;]+;|[BCDFIJSZ])"), 0)
    primitive = F.create_map(*(F.lit(x) for pair in PRIMITIVES.items() for x in pair))

    def name(text: Column) -> Column:
        plain = F.regexp_replace(text, r"^\[+", "")
        base = F.when(plain.startswith("L"), F.translate(F.regexp_extract(plain, r"^L(.*);$", 1), "/", ".")).otherwise(F.element_at(primitive, plain))
        return F.concat(base, F.repeat(F.lit("[]"), F.length(text) - F.length(plain)))

    return F.transform(parts, name)


def _node(kind: str, *parts) -> Column:
    return F.concat_ws("|", F.lit(kind), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def call_sites(rows: DataFrame) -> DataFrame:
    """Calls as the matcher wants them, node a text; receiver types are the named class and what is known above it."""
    own = class_files.calls(rows.where("kind <> 'dynamic'"))
    raw = rows.where(F.col("kind").isin("virtual", "special", "static", "interface")).select("path", class_files.function_of().alias("func"), "at", "owner", "name", "type", F.concat_ws(".", "class", "method").alias("function_name"))
    met = own.join(raw, ["path", "func", "at"])
    above = calls.closure(class_files.supertypes(rows)).groupBy(F.col("sub").alias("owner")).agg(F.array_sort(F.collect_set("super")).alias("above"))
    types, none = java_types(F.col("type")), lambda t: F.lit(None).cast(t)
    on = F.when(F.col("kind") != "static", F.col("owner"))
    return met.join(above, "owner", "left").select(
        F.lit("java").alias("language"), "path", "line", F.xxhash64("path", "func").alias("func_id"), _node("call", "path", "func", "at").alias("node"), "function_name", F.col("callee").alias("callee_name"),
        F.col("name").alias("method_name"), on.alias("receiver_type"), F.when(on.isNotNull(), F.coalesce("above", F.array("owner"))).alias("receiver_type_candidates"), none("int").alias("receiver_parameter"),
        none("string").alias("receiver_origin"), F.col("arity").alias("arg_count"), types.alias("arg_types"), F.transform(types, lambda t: F.array(t)).alias("arg_type_candidates"),
    )


def flow(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, dst, kind, site) between nodes as texts, and ports(node, at, is) of calls."""
    func = class_files.function_of()
    at = rows.withColumn("func", func)
    value = lambda c: _node("value", "path", "func", c)
    edge = lambda df, src, dst, kind="flow", site=None: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("kind"), (F.lit(None).cast("string") if site is None else site).alias("site"))

    # within a method
    sources = F.when(F.col("kind") == "load_index", F.slice("args", 1, 1)).otherwise(F.col("args"))
    made = at.where(F.col("kind").isin("phi", "copy", "unary", "binary", "load_index")).select("path", "func", "dst", F.explode(sources).alias("a"))
    edges = edge(made, value(F.col("a.value")), value("dst"))
    stored = at.where("kind = 'store_index'")
    edges = edges.unionByName(edge(stored, value(F.col("args")[2]["value"]), value(F.col("args")[0]["value"])))
    field = _node("field", "owner", "name")
    edges = edges.unionByName(edge(at.where("kind = 'store_field'"), value(F.col("args")[0]["value"]), field)).unionByName(edge(at.where("kind = 'load_field'"), field, value("dst")))

    # calls: values into ports, and what the call gives
    met = written(at.where(F.col("kind").isin(*class_files.INVOKES.values())).select("path", "func", "at", "kind", "owner", "name", "type", "receiver", "args", "dst"), "calls")
    call, port = _node("call", "path", "func", "at"), lambda p: _node("port", "path", "func", "at", p)
    shift = F.col("receiver").isNotNull().cast("int")
    given = met.select("*", F.posexplode("args").alias("nth", "a")).select("path", "func", "at", "kind", "owner", "name", "type", "receiver", F.col("a.value").alias("v"), F.concat(F.lit("arg"), F.col("nth").cast("string")).alias("port"), (F.col("nth") + shift).alias("place"))
    on = met.where("receiver is not null").select("path", "func", "at", "kind", "owner", "name", "type", "receiver", F.col("receiver").alias("v"), F.lit("receiver").alias("port"), F.lit(0).alias("place"))
    ports = given.unionByName(on)
    edges = edges.unionByName(edge(ports, value("v"), port("port"))).unionByName(edge(met.where("dst is not null"), call, value("dst")))

    # methods that are here, under each type that they can be called by
    methods = at.where("kind = 'method'").select("path", "func", F.col("class").alias("sub"), F.col("method").alias("name"), F.col("descriptor").alias("type"))
    known = methods.join(calls.closure(class_files.supertypes(rows)).select("sub", F.col("super").alias("owner")), "sub")
    known = written(known.select("path", "func", "sub", "owner", "name", "type").where("name <> '<init>' or sub = owner"), "methods")
    asked, key = met.select("owner", "name", "type").distinct(), ["owner", "name", "type"]
    able = known.join(asked, key, "left_semi")
    target = lambda p: _node("target", *key, p)
    formals = at.where("kind = 'parameter'").select("path", "func", F.col("name").alias("nth"), "dst")
    edges = edges.unionByName(edge(able.join(formals, ["path", "func"]), target("nth"), value("dst")))
    back = at.where("kind = 'return' and size(args) > 0").select("path", "func", F.col("args")[0]["value"].alias("v"))
    edges = edges.unionByName(edge(able.join(back, ["path", "func"]), value("v"), target(F.lit("return"))))
    has = able.select(*key).distinct()
    inside = ports.join(has, key, "left_semi")
    edges = edges.unionByName(edge(inside, port("port"), target("place"), "enter", call)).unionByName(edge(met.join(has, key, "left_semi"), target(F.lit("return")), call, "leave", call))

    # calls that leave what is known: what they are given is in what they give, and in what they fill
    reads, exact = containers.replayed(*class_files.collection_facts(rows))
    place = [F.col("func"), F.col("at").alias("pos")]
    general = ports.join(has, key, "left_anti").select("*", *place[1:]).join(exact, ["func", "pos"], "left_anti")
    filled = general.where(F.col("name").rlike(FILLERS) & (F.col("port") != "receiver") & F.col("receiver").isNotNull())
    edges = edges.unionByName(edge(general, port("port"), call)).unionByName(edge(filled, port("port"), value("receiver")))
    held = reads.join(rows.select("path", func.alias("func")).distinct(), "func")
    edges = edges.unionByName(edge(held, value("element"), value("result")))
    return edges.distinct(), ports.select(call.alias("node"), port("port").alias("at"), F.col("port").alias("is"))


def scan(files: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None) -> DataFrame:
    """Findings in the class files among files(path, content binary); rules as taint_scan.scan() takes them, locations are the
    path and line of the call. A class that stands in several files counts once, by its first path."""
    all_rows = written(class_files.decoded(files), "decoded")
    first = all_rows.where("kind = 'class'").groupBy("class").agg(F.min("path").alias("path"))
    rows = written(all_rows.join(first, ["path", "class"], "left_semi"), "rows")
    edges, ports = flow(rows)
    edges, ports, sites = written(edges, "edges"), written(ports, "ports"), written(call_sites(rows), "sites")
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).union(sites.select("node")).union(ports.select("at"))
    numbers = written(heap.catalog(names, "name"), "numbers")
    number = lambda df, c: df.join(numbers.select(F.col("name").alias(c), F.col("object").alias("__n")), c, "left").drop(c).withColumnRenamed("__n", c)
    none = F.lit(None).cast("array<string>")
    edges = number(number(number(edges, "src"), "dst"), "site").withColumn("remove", none).withColumn("add", none)
    sites = written(number(sites, "node"), "numbered")
    ports = written(number(number(ports, "node"), "at"), "numbered-ports")
    return taint_scan.search(sites, written(edges.select("src", "dst", "kind", "site", "remove", "add"), "numbered-edges"), ports, sources, sinks, sanitizers)
