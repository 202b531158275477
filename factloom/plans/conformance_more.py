"""More operators on the supplied tables: closures, propagation, ranks, names, addresses, literals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import graph, matching, rows, taint
from factloom.plans.conformance import EDGES_SQL, ORACLES, SINKS_SQL, SOURCES_SQL, query, trade_edges, trade_ends
from factloom.session import table, written


_HOPS_SQL = "h AS (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY event_id, user_id) AS dst FROM events), e AS (SELECT DISTINCT src, dst FROM h WHERE src IS NOT NULL AND dst IS NOT NULL)"
_ROOTS_SQL = """c(x, y) AS (SELECT src, dst FROM e UNION SELECT x, dst FROM c JOIN e ON y = src), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), m AS (SELECT a.x, max(a.y) AS y FROM c a JOIN c b ON a.x = b.y AND a.y = b.x GROUP BY a.x),
s AS (SELECT node, greatest(node, coalesce(y, node)) AS root FROM n LEFT JOIN m ON x = node)"""


#: Events whose id falls in one stretch are one task's share of a type's order.
STRETCH = 10_000


def all_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the user of every event to the user of the next event of its type. The order is cut into stretches of ids, so a
    frequent type is many tasks; the last event of a stretch goes on to the first of the type's next stretch."""
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "user_id", F.floor(F.col("event_id") / STRETCH).alias("stretch"))
    by = Window.partitionBy("event_type", "stretch").orderBy("event_id", "user_id")
    inside = events.select("event_type", "stretch", F.col("user_id").alias("src"), F.lead(F.struct("user_id")).over(by).alias("after"))
    heads = events.groupBy("event_type", "stretch").agg(F.min(F.struct("event_id", "user_id")).alias("head"))
    heads = heads.select(F.col("event_type").alias("t"), F.col("stretch").alias("s"), F.lead("head.user_id").over(Window.partitionBy("event_type").orderBy("stretch")).alias("beyond"))
    hops = inside.join(heads, F.col("event_type").eqNullSafe(F.col("t")) & F.col("stretch").eqNullSafe(F.col("s")))
    dst = F.when(F.col("after").isNull(), F.col("beyond")).otherwise(F.col("after.user_id"))
    return hops.select("src", dst.alias("dst")).where("src is not null and dst is not null").distinct()


@query(f"WITH RECURSIVE {_HOPS_SQL}, {_ROOTS_SQL} SELECT node, root FROM s")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected components of the hops of all events, named by their largest node."""
    return graph.strong_components(all_hops(spark, sf_dir))


@query(f"WITH RECURSIVE {_HOPS_SQL}, {_ROOTS_SQL} SELECT node, root FROM s")
def strong_components_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by colouring, as for graphs that one task can't hold."""
    return graph.strong_components(all_hops(spark, sf_dir), local=0)


@query(f"""
WITH RECURSIVE {_HOPS_SQL}, {_ROOTS_SQL},
g AS (SELECT DISTINCT a.root AS src, b.root AS dst FROM e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst WHERE a.root <> b.root),
r(node, depth) AS (SELECT DISTINCT root, 0 FROM s WHERE node IN (SELECT user_id FROM events WHERE event_type = 'signup') UNION SELECT g.dst, depth + 1 FROM r JOIN g ON g.src = r.node WHERE depth < 3)
SELECT s.node, min(depth) AS depth FROM r JOIN s ON s.root = r.node GROUP BY s.node
""")
def reach_condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability over the hops of all events whose depth counts strongly connected components, from all users that signed up."""
    edges = written(all_hops(spark, sf_dir), "hops")
    signed = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("node"))
    starts = edges.select(F.col("src").alias("node")).union(edges.select("dst")).join(signed, "node", "left_semi")
    return graph.reach_condensed(edges, starts, 3)[0]


@query(ORACLES["reach_condensed"])
def reach_condensed_coloured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over components by colouring, as for graphs that one task can't hold."""
    edges = written(all_hops(spark, sf_dir), "hops")
    signed = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("user_id").alias("node"))
    starts = edges.select(F.col("src").alias("node")).union(edges.select("dst")).join(signed, "node", "left_semi")
    return graph.reach_condensed(edges, starts, 3, local=0)[0]


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
f(node, fact) AS (SELECT 'c' || c_custkey, c_mktsegment FROM customer UNION SELECT dst, fact FROM f JOIN e ON src = node)
SELECT node, fact FROM f
""")
def propagate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points-to propagation: which segments' customers reach each node."""
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("fact"))
    return graph.propagate(seeds, trade_edges(spark, sf_dir))


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
b(node, depth) AS ({SINKS_SQL.replace(" AS node", " AS node, 0 AS depth")} UNION SELECT src, depth + 1 FROM b JOIN e ON dst = node WHERE depth < 2)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM b GROUP BY node
""")
def reach_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reaches the sinks in two steps."""
    found, _ = graph.reach(trade_edges(spark, sf_dir), trade_ends(spark, sf_dir)[1], 2, backward=True, probe=False)
    return found.select("node", F.col("depth").cast("long").alias("depth"))


_NUMBER = lambda c: f"(ascii({c}) * 1099511627776 + CAST(substr({c}, 2) AS BIGINT))"
#: Each source rule is reported once for a sink: from its first source, along the way whose nodes come first.
WITNESS_SQL = f"""
WITH {EDGES_SQL.strip()}, s0 AS ({SOURCES_SQL}), k AS ({SINKS_SQL}),
w AS (SELECT k.node AS sink, a.src AS c, a.dst AS o, b.dst AS p FROM k JOIN e d ON d.dst = k.node JOIN e b ON b.dst = d.src JOIN e a ON a.dst = b.src JOIN s0 ON s0.node = a.src),
m AS (SELECT sink, min(struct_pack(c := {_NUMBER("c")}, o := {_NUMBER("o")}, p := {_NUMBER("p")})) AS m FROM w GROUP BY sink)
SELECT 'segment' AS source_rule_id, 'supplier' AS sink_rule_id, sink AS location, m.c AS source_node, {_NUMBER("sink")} AS sink_node, m.c || '>' || m.o || '>' || m.p || '>' || {_NUMBER("sink")} AS path, 'complete' AS completeness FROM m
"""


@query(WITNESS_SQL)
def witness_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint findings with their witness paths on the trade graph. tests/test_facts.py holds the search, with labels and calls,
    against hand-written graphs."""
    return witnesses(spark, sf_dir, *trade_ends(spark, sf_dir))


def witnesses(spark: SparkSession, sf_dir: str, sources: DataFrame, sinks: DataFrame) -> DataFrame:
    edges = trade_edges(spark, sf_dir)
    number = lambda c: (F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("long") * F.lit(1 << 40)) + F.substring(c, 2, 20).cast("long")
    none = F.lit(None).cast("array<string>")
    flow = edges.distinct().select(number("src").alias("src"), number("dst").alias("dst"), F.lit("flow").alias("kind"), F.lit(None).cast("long").alias("site"), none.alias("remove"), none.alias("add"))
    s = sources.select(number("node").alias("node"), F.lit("segment").alias("rule_id"), F.lit("generic").alias("kind"))
    k = sinks.select(number("node").alias("node"), F.lit("supplier").alias("rule_id"), F.lit("generic").alias("kind"), F.col("node").alias("location"))
    found = taint.search(flow, s, k, 3, limit=None)
    return found.select("source_rule_id", "sink_rule_id", "location", "source_node", "sink_node", F.array_join(F.transform("path", lambda n: n.cast("string")), ">").alias("path"), "completeness")


# --- the walks from all customers, of every segment; SQL as above without the segment --------------------------------
def everyone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))


def every_segment(name: str) -> str:
    return ORACLES[name].replace(" WHERE c_mktsegment = 'BUILDING'", "")


@query(every_segment("reach_bounded"))
def reach_bounded_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all customers reach in two steps."""
    found, _ = graph.reach(trade_edges(spark, sf_dir), everyone(spark, sf_dir), 2, probe=False)
    return found.select("node", F.col("depth").cast("long").alias("depth"))


@query(every_segment("taint_reach_pairs"))
def taint_reach_pairs_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on ways from all customers to sink suppliers."""
    found = graph.slice_between(trade_edges(spark, sf_dir), everyone(spark, sf_dir), trade_ends(spark, sf_dir)[1], 3)
    return found.select("node", F.col("fwd_depth").cast("long").alias("fwd_depth"), F.col("bwd_depth").cast("long").alias("bwd_depth"))


@query(every_segment("shortest_dep_path"))
def shortest_dep_path_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest way from all customers to each supplier, the smallest parent first."""
    found = graph.shortest_paths(trade_edges(spark, sf_dir), everyone(spark, sf_dir), 3)
    return found.where(F.startswith("node", F.lit("s"))).select("node", F.array_join("path", ">").alias("path"))


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
f(node, fact) AS (SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT dst, fact FROM f JOIN e ON src = node)
SELECT node, fact FROM f
""")
def propagate_facts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points-to propagation: which nations' customers reach each node."""
    seeds = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("fact"))
    return graph.propagate(seeds, trade_edges(spark, sf_dir))


@query(every_segment("witness_findings"))
def witness_findings_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taint findings from all customers."""
    return witnesses(spark, sf_dir, everyone(spark, sf_dir), trade_ends(spark, sf_dir)[1])


@query("""
SELECT p_partkey, split_part(p_name, ' ', 1) AS receiver, split_part(p_name, ' ', 2) AS method FROM part
""")
def callee_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualified names as receiver and method."""
    receiver, method = matching.split_callee(F.translate("p_name", " ", "."))
    return table(spark, sf_dir, "part").select("p_partkey", receiver.alias("receiver"), method.alias("method"))


@query("""
WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1)
SELECT c_custkey, o_orderkey, round(o_totalprice, 2) AS price FROM customer LEFT JOIN a ON c_custkey = o_custkey
""")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best candidate of each key, or NULL."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice").withColumn("place", F.struct(-F.col("o_totalprice"), "o_orderkey"))
    best = rows.first_wins(orders, ["c_custkey"], "place")
    return table(spark, sf_dir, "customer").select("c_custkey").join(best, "c_custkey", "left").select("c_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("price"))
