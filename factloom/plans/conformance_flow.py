"""Flow graph construction, rule packs and exports on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import flow, graph, heap, rulesets, text_rules
from factloom.plans import reports
from factloom.plans.conformance import EDGES_SQL, query, trade_edges
from factloom.session import table
from factloom.sources import manifests


def _text(c) -> F.Column:
    return c.cast("string")


@query("""
SELECT 'value:' || l_partkey AS src, 'port:' || l_orderkey || ':arg' || l_linenumber AS dst, 'argument' AS kind FROM lineitem
UNION ALL SELECT 'value:' || o_custkey, 'port:' || o_orderkey || ':receiver', 'receiver' FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'port:' || o_orderkey || ':return', 'value:' || -o_orderkey, 'result' FROM orders
""")
def call_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values into ports and out of them: orders are calls, their lines arguments."""
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), (-F.col("o_orderkey")).alias("result"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("receiver"))
    return flow.call_ports(made, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("value")))


@query("""
SELECT 'value:' || l_partkey AS src, 'formal:' || (l_suppkey * 10 + l_linenumber) AS dst, 'enter' AS kind, l_orderkey AS site FROM lineitem
UNION ALL SELECT 'value:' || s_suppkey, 'port:' || l_orderkey || ':return', 'leave', l_orderkey FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal > 0
""")
def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments enter functions and results leave them."""
    lines = table(spark, sf_dir, "lineitem")
    bound = lines.select(F.col("l_orderkey").alias("call"), (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("formal"), F.col("l_partkey").alias("value"))
    returns = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("function"), F.col("s_suppkey").alias("value"))
    return flow.call_edges(bound, returns, lines.select(F.col("l_orderkey").alias("call"), F.col("l_suppkey").alias("function")).distinct())


_PORTS = [("error", "args_from1", "sql"), ("view", "arg0", ""), ("view", "return", "web")]


@query("""
WITH m AS (SELECT event_id, event_type, event_id % 4 AS arity FROM events),
x AS (SELECT event_id, event_type, 'sql' AS kind, 'arg' || unnest(range(1, arity)) AS port FROM m WHERE event_type = 'error' UNION ALL SELECT event_id, event_type, 'generic', 'arg0' FROM m WHERE event_type = 'view' UNION ALL SELECT event_id, event_type, 'web', 'return' FROM m WHERE event_type = 'view')
SELECT 'source:' || event_id || ':' || event_type || ':' || port AS node, 'port:' || event_id || ':' || port AS port, event_type AS rule_id, kind FROM x
""")
def source_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic nodes for every matched rule and port, variadic ones expanded."""
    ports = spark.createDataFrame(_PORTS, "rule_id string, port string, kind string")
    matches = table(spark, sf_dir, "events").select(F.col("event_id").alias("call"), (F.col("event_id") % 4).alias("arity"), F.col("event_type").alias("rule_id"))
    return flow.seeds(matches, ports, "source")


@query("""
WITH m AS (SELECT event_id, event_type, event_id % 4 AS arity FROM events), a AS (SELECT event_id, unnest(range(0, arity)) AS i FROM m WHERE event_type = 'click')
SELECT 'port:' || event_id || ':arg' || i AS src, 'port:' || event_id || ':return' AS dst, 'click' AS rule_id, FALSE AS back FROM a
UNION ALL SELECT 'port:' || event_id || ':arg0', 'port:' || event_id || ':receiver', 'signup', TRUE FROM m WHERE event_type = 'signup'
""")
def rule_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls pass from port to port, and which of it is written back."""
    flows = spark.createDataFrame([("click", "args_from0", "return"), ("signup", "arg0", "receiver"), ("signup", "arg0", "arg0")], "rule_id string, inp string, outp string")
    matches = table(spark, sf_dir, "events").select(F.col("event_id").alias("call"), (F.col("event_id") % 4).alias("arity"), F.col("event_type").alias("rule_id"))
    return flow.summaries(matches, flows)


@query("""
WITH m AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'append' WHEN 'view' THEN 'setdefault' WHEN 'click' THEN 'str' ELSE 'other' END AS method, CASE user_id % 2 WHEN 0 THEN 'python' ELSE 'go' END AS language FROM events),
x AS (SELECT event_id, 'arg0' AS i, 'receiver' AS o FROM m WHERE method = 'append' UNION ALL SELECT event_id, 'arg1', 'receiver' FROM m WHERE method = 'setdefault' UNION ALL SELECT event_id, 'arg1', 'return' FROM m WHERE method = 'setdefault'
UNION ALL SELECT event_id, 'arg0', 'return' FROM m WHERE method = 'str' AND language = 'python' UNION ALL SELECT event_id, unnest(['arg0', 'arg1']), 'return' FROM m WHERE method = 'append' AND language = 'go')
SELECT event_id AS call, 'port:' || event_id || ':' || i AS src, 'port:' || event_id || ':' || o AS dst FROM x
""")
def container_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of container methods and language-level calls."""
    method = F.when(F.col("event_type") == "error", "append").when(F.col("event_type") == "view", "setdefault").when(F.col("event_type") == "click", "str").otherwise("other")
    made = table(spark, sf_dir, "events").select(F.col("event_id").alias("call"), F.when(F.col("user_id") % 2 == 0, "python").otherwise("go").alias("language"), method.alias("method"))
    return flow.modelled(made, spark)


@query("""
WITH l AS (SELECT o_orderkey AS lam, o_custkey AS func, o_orderkey AS until, unnest([o_orderkey % 3, o_orderkey % 5]) AS name FROM orders WHERE o_orderstatus = 'F'),
s AS (SELECT o_custkey AS func, o_orderkey AS pos, o_orderkey % 5 AS name, o_orderkey * 2 AS value FROM orders WHERE o_orderstatus = 'O')
SELECT lam AS lambda, l.name, arg_max(value, pos) AS value FROM l JOIN s ON l.func = s.func AND l.name = s.name AND pos < until GROUP BY ALL
""")
def lambda_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that lambdas take along from the function around them."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    lambdas = orders.where("o_orderstatus = 'F'").select(k.alias("lambda"), F.col("o_custkey").alias("func"), k.alias("at"), F.array(k % 3, k % 5).alias("names"))
    return flow.captures(lambdas, orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("func"), k.alias("at"), (k % 5).alias("name"), (k * 2).alias("value")))


@query("""
SELECT p_partkey AS value, CASE p_size % 10 WHEN 1 THEN 'one' ELSE 'two' END AS rule_id FROM part WHERE p_size % 10 IN (1, 2)
""")
def named_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are sources by their name."""
    values = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("value"), F.concat(F.lit("n"), _text(F.col("p_size") % 10)).alias("name"))
    return flow.named_sources(values, spark.createDataFrame([("one", "n1"), ("two", "n2")], "rule_id string, name string"))


@query("""
SELECT event_id AS call, CASE WHEN value > 400 THEN 'given' WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'exact' WHEN event_type = 'view' THEN 'short' END AS type FROM events
""")
def call_result_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of results: as written, by qualified name, by simple name."""
    callee = F.concat(F.when(F.col("user_id") % 2 == 0, "a.").otherwise("b."), F.col("event_type"))
    made = table(spark, sf_dir, "events").select(F.col("event_id").alias("call"), callee.alias("callee"), F.when(F.col("value") > 400, "given").alias("result_type"))
    return flow.return_types(made, spark.createDataFrame([("a.click", "exact"), ("view", "short")], "callee string, type string"))


@query("""
WITH c AS (SELECT DISTINCT l_orderkey AS func, 0 AS switch, l_linenumber AS nth, l_linenumber AS block FROM lineitem), m AS (SELECT func, max(nth) AS last FROM c GROUP BY func)
SELECT func, switch, nth, block FROM c JOIN m USING (func) WHERE nth < last AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = func AND l_linenumber = block AND l_returnflag <> 'N')
""")
def case_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that fall through to the next."""
    lines = table(spark, sf_dir, "lineitem")
    cases = lines.select(F.col("l_orderkey").alias("func"), F.lit(0).alias("switch"), F.col("l_linenumber").alias("nth"), F.col("l_linenumber").alias("block")).distinct()
    kind = F.when(F.col("l_returnflag") == "R", "return").when(F.col("l_returnflag") == "A", "break").otherwise("jump")
    return flow.case_breaks(cases, lines.select(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("block"), kind.alias("kind")))


@query("""
SELECT n_nationkey AS node, 'nation ' || CASE WHEN n_nationkey % 4 = 0 THEN '?' ELSE n_name END AS label, CASE WHEN n_regionkey < 3 THEN 'r' || n_regionkey || ':' || n_nationkey END AS location FROM nation
""")
def described_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and places of nodes."""
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_nationkey").alias("node"), F.lit("nation").alias("kind"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_name")).alias("name"))
    return flow.described(nodes, nation.where("n_regionkey < 3").select(F.col("n_nationkey").alias("node"), F.concat(F.lit("r"), _text(F.col("n_regionkey"))).alias("path"), F.col("n_nationkey").alias("line")))


@query("""
SELECT o_orderkey AS value, string_agg(CASE WHEN l_returnflag = 'R' THEN '{}' ELSE l_linestatus || l_linenumber END, '' ORDER BY l_linenumber, CASE WHEN l_returnflag = 'R' THEN '{}' ELSE l_linestatus || l_linenumber END) AS text FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey
""")
def string_reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts from their pieces, with marks for what isn't known."""
    literal = F.when(F.col("l_returnflag") != "R", F.concat("l_linestatus", _text(F.col("l_linenumber"))))
    pieces = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("value"), F.col("l_linenumber").alias("place"), literal.alias("literal"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("value"))
    return flow.reconstructed(pieces.join(known, "value", "left_semi"))


@query("""
SELECT 'L-' || l_returnflag AS rule_id, l_orderkey AS func, l_linenumber AS value FROM lineitem WHERE l_returnflag = 'R'
""")
def lifetime_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems become findings where their rule is on."""
    problems = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("value"), F.col("l_returnflag").alias("problem"))
    return flow.diagnostics(problems, spark.createDataFrame([("R", "L-R", True), ("A", "L-A", False)], "problem string, rule_id string, enabled boolean"))


@query("""
SELECT 'sink-b' || s_suppkey AS rule_id, 'sink' AS family, 'p' || s_nationkey AS callee, 'arg0' AS port FROM supplier UNION ALL SELECT 'source-b' || s_suppkey, 'source', 'c' || s_nationkey, 'arg0' FROM supplier WHERE s_acctbal > 0
""")
def boundary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sinks and sources at the two sides of a boundary."""
    nation = _text(F.col("s_nationkey"))
    mappings = table(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), _text(F.col("s_suppkey"))).alias("boundary"), F.concat(F.lit("p"), nation).alias("producer"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("c"), nation)).alias("consumer"))
    return flow.boundary_rules(mappings)


@query("""
WITH o AS (SELECT user_id, list(list_sort(list_distinct([event_type || event_id % 5, 'v' || event_id % 9, 't' || event_id % 4][1:1 + event_id % 3])) ORDER BY event_id) AS all_ids, list(event_id ORDER BY event_id) AS pos FROM events GROUP BY user_id),
p AS (SELECT user_id, list_transform(range(1, len(pos) + 1), lambda i: {'pos': pos[i], 'ids': all_ids[i]}) AS x FROM o),
f AS (SELECT user_id, list_reduce(x, lambda acc, y: CASE WHEN list_position(list_transform(acc, lambda e: list_has_any(e.ids, y[1].ids)), TRUE) IS NULL THEN list_concat(acc, y)
ELSE list_transform(acc, lambda e, i: CASE WHEN i = list_position(list_transform(acc, lambda e: list_has_any(e.ids, y[1].ids)), TRUE) THEN {'pos': e.pos, 'ids': list_sort(list_distinct(list_concat(e.ids, y[1].ids)))} ELSE e END) END, []) AS acc FROM (SELECT user_id, list_transform(x, lambda e: [e]) AS x FROM p))
SELECT user_id AS package, e.pos AS ordinal, array_to_string(e.ids, ',') AS ids FROM (SELECT user_id, unnest(acc) AS e FROM f)
""")
def observation_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a package whose sets of ids overlap, folded in their order."""
    k = F.col("event_id")
    ids = F.slice(F.array(F.concat("event_type", _text(k % 5)), F.concat(F.lit("v"), _text(k % 9)), F.concat(F.lit("t"), _text(k % 4))), 1, (1 + k % 3).cast("int"))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), ids.alias("ids"), k.alias("ordinal"))
    return flow.observations(rows).select("package", "ordinal", F.array_join("ids", ",").alias("ids"))


@query("""
WITH r AS (SELECT p_partkey AS id, list_distinct(['CWE-' || p_size % 4, 'CWE-' || p_size % 3]) AS cwe, list_distinct(['l' || p_partkey % 3, 'l' || p_partkey % 2]) AS languages FROM part)
SELECT id, array_to_string(list_sort(list_filter(languages, lambda x: x <> 'l1')), ',') AS languages FROM r WHERE len(list_filter(cwe, lambda x: x NOT IN ('CWE-0', 'CWE-1'))) > 0 AND len(list_filter(languages, lambda x: x <> 'l1')) > 0
""")
def pack_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A curated pack: without rules that others stand for, and without a language."""
    named = lambda p, *cs: F.array_distinct(F.array(*(F.concat(F.lit(p), _text(c)) for c in cs)))
    size, key = F.col("p_size"), F.col("p_partkey")
    rules = table(spark, sf_dir, "part").select(key.alias("id"), named("CWE-", size % 4, size % 3).alias("cwe"), named("l", key % 3, key % 2).alias("languages"))
    return rulesets.curated(rules, ["CWE-0", "CWE-1"], ["l1"]).select("id", F.array_join(F.array_sort("languages"), ",").alias("languages"))


@query("""
SELECT 'p' || p_partkey AS id, p_brand AS name FROM part UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier
""")
def pack_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs side by side, their ids unique."""
    one = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), _text(F.col("p_partkey"))).alias("id"), F.col("p_brand").alias("name"))
    return rulesets.pack(one, table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), _text(F.col("s_suppkey"))).alias("id"), F.col("s_name").alias("name")))


@query("""
WITH c AS (SELECT o_orderkey AS tree, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_quantity > 40) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT tree, 'returned' AS rule_id, CAST(r AS INTEGER) AS n FROM c WHERE r > 0 UNION ALL SELECT tree, 'large', CAST(q AS INTEGER) FROM c WHERE q > 0
""")
def xpath_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XPath over trees: orders with their lines as syntax trees."""
    line = F.format_string('<line q="%d"><flag>%s</flag></line>', F.col("l_quantity").cast("int"), "l_returnflag")
    trees = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tree")).agg(F.concat(F.lit("<order>"), F.array_join(F.collect_list(line), ""), F.lit("</order>")).alias("xml"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tree"))
    return text_rules.xpath_matches(trees.join(known, "tree", "left_semi"), [("returned", "//line[flag='R']"), ("large", "/order/line[@q>40]"), ("none", "//other")])


@query("""
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'config' WHEN 1 THEN 'packed' WHEN 2 THEN 'packed' END AS what FROM part WHERE p_size % 4 < 3
""")
def auxiliary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration files, archives and compiled code by name."""
    k = F.col("p_size") % 4
    name = F.when(k == 0, "/conf/application-dev.yml").when(k == 1, "/lib/a.TAR.gz").when(k == 2, "/C.class").otherwise("/notes.txt")
    return manifests.auxiliary(table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("d"), _text(F.col("p_partkey")), name).alias("path"))).select("p_partkey", "what")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'other==' || p_size || '.0' WHEN p_size % 3 = 1 THEN 'pkg==' || (p_size + 1) || '.5' ELSE 'pkg==' || p_size || '.0' END AS line FROM part
""")
def manifest_bump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines moved to the version that is safe."""
    size = F.col("p_size")
    version = F.concat(_text(size), F.lit(".0"))
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.when(size % 3 == 0, "other==").otherwise("pkg=="), version).alias("line"), F.lit("pkg").alias("name"), version.alias("version"), F.when(size % 3 != 2, F.concat(_text(size + 1), F.lit(".5"))).alias("fix"))
    return manifests.bumped(lines).select("p_partkey", "line")


@query("""
SELECT 'node' AS what, 'n' || n_nationkey AS a, n_name AS b FROM nation UNION ALL SELECT 'edge', 'n' || n_nationkey, 'r' || n_regionkey FROM nation
""")
def system_graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service graph as JSON objects."""
    nation = table(spark, sf_dir, "nation")
    key = F.concat(F.lit("n"), _text(F.col("n_nationkey")))
    nodes = nation.select(key.alias("id"), F.lit("service").alias("kind"), F.col("n_name").alias("name"), F.create_map(F.lit("k"), F.lit("v")).alias("attrs"))
    edges = nation.select(key.alias("src"), F.concat(F.lit("r"), _text(F.col("n_regionkey"))).alias("dst"), F.lit("calls").alias("kind"), F.lit("high").alias("confidence"), F.array(F.lit("e")).alias("evidence"))
    out = reports.system_graph_json(nodes, edges)
    at = lambda p: F.get_json_object("value", p)
    return out.select("what", F.coalesce(at("$.id"), at("$.src")).alias("a"), F.coalesce(at("$.name"), at("$.dst")).alias("b"))


@query(f"""
WITH {EDGES_SQL.strip()}, r AS (SELECT 'c' || c_custkey AS node FROM customer), p1 AS (SELECT dst AS node, min(src) AS p FROM e JOIN r ON src = node GROUP BY dst), p2 AS (SELECT dst AS node, min(src) AS p FROM e JOIN p1 ON src = node GROUP BY dst),
p3 AS (SELECT dst AS node, min(src) AS p FROM e JOIN p2 ON src = node GROUP BY dst)
SELECT node AS function, node AS path, CAST(0 AS INTEGER) AS depth FROM r UNION ALL SELECT node, p || '>' || node, 1 FROM p1 UNION ALL SELECT p2.node, p1.p || '>' || p2.p || '>' || p2.node, 2 FROM p2 JOIN p1 ON p1.node = p2.p
UNION ALL SELECT p3.node, p1.p || '>' || p2.p || '>' || p3.p || '>' || p3.node, 3 FROM p3 JOIN p2 ON p2.node = p3.p JOIN p1 ON p1.node = p2.p
""")
def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest call paths from entries, to any depth that there is."""
    entries = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), _text(F.col("c_custkey"))).alias("node"))
    return graph.shortest_paths(trade_edges(spark, sf_dir), entries, 4).select(F.col("node").alias("function"), F.array_join("path", ">").alias("path"), "depth")


@query("""
WITH RECURSIVE a AS (SELECT DISTINCT 'r' || o_custkey % 30 || CASE WHEN o_orderkey % 3 = 0 THEN '.f' ELSE '' END AS a FROM orders), b AS (SELECT DISTINCT 'r' || s_suppkey % 30 || '.f' || CASE WHEN s_suppkey % 2 = 0 THEN '[1]' ELSE '' END AS b FROM supplier),
p AS (SELECT a AS x, b AS y FROM a JOIN b ON a = b OR starts_with(b, a || '.') OR starts_with(b, a || '[')), e AS (SELECT x, y FROM p UNION SELECT y, x FROM p), r(node, root) AS (SELECT x, x FROM e UNION SELECT y, root FROM r JOIN e ON x = node)
SELECT node, min(root) AS root FROM r GROUP BY node
""")
def region_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions that hold each other, as connected groups."""
    left = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), _text(F.col("o_custkey") % 30), F.when(F.col("o_orderkey") % 3 == 0, ".f").otherwise("")).alias("a"))
    right = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), _text(F.col("s_suppkey") % 30), F.lit(".f"), F.when(F.col("s_suppkey") % 2 == 0, "[1]").otherwise("")).alias("b"))
    pairs = heap.regions_related(left, right)
    return graph.components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 1000 AS ctx, l_partkey % 40 AS src, l_suppkey % 40 AS dst FROM lineitem), s AS (SELECT DISTINCT ctx, src AS node, 'o' || src % 3 AS fact FROM e WHERE src < 6),
f(ctx, node, fact) AS (SELECT ctx, node, fact FROM s UNION SELECT f.ctx, e.dst, fact FROM f JOIN e ON e.ctx = f.ctx AND e.src = f.node)
SELECT ctx, node, fact FROM f
""")
def contextual_points_to(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that values may point to, context by context."""
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("ctx"), (F.col("l_partkey") % 40).alias("src"), (F.col("l_suppkey") % 40).alias("dst"))
    seeds = edges.where("src < 6").select("ctx", F.col("src").alias("node"), F.concat(F.lit("o"), _text(F.col("src") % 3)).alias("fact"))
    return graph.propagate_in_context(seeds, edges)
