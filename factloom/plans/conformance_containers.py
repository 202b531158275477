"""Local collections, receiver labels and nodes of rules on the supplied tables: a user's events are calls on the user's one list,
map or object, in their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import calls, containers, flow, receiver_labels
from factloom.plans import reports
from factloom.plans.conformance import query
from factloom.session import table, written


def _literal(text: Column, whole: bool) -> Column:
    return F.struct(F.lit(None).cast("long").alias("value"), text.cast("string").alias("literal"), F.lit(whole).alias("whole"))


def _replayed(rows: DataFrame, kind: str, method: Column, args: Column) -> tuple[DataFrame, DataFrame]:
    """Users' containers: made at place 0 as value -1, called by way of a copy (-2) from each third call on."""
    none = F.expr(f"cast(array() as {containers.ARGS})")
    users = rows.select(F.col("f").alias("func")).distinct()
    makers = users.select("func", F.lit(0).alias("block"), F.lit(0).cast("int").alias("pos"), F.lit(-1).cast("long").alias("value"), F.lit(kind).alias("type"), none.alias("args"))
    copies = users.select("func", F.lit(-2).cast("long").alias("dst"), F.lit(-1).cast("long").alias("src"))
    value = F.when(F.col("k") % 3 == 0, F.lit(-2)).otherwise(F.lit(-1)).cast("long")
    uses = rows.select(F.col("f").alias("func"), F.lit(0).alias("block"), F.col("k").alias("pos"), value.alias("value"), F.when(F.col("value") > 350, "argument").otherwise("receiver").alias("role"), method.alias("method"), args.alias("args"), F.col("event_id").alias("result"))
    return containers.replayed(makers, uses, copies)


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("user_id").orderBy("event_id")
    return written(table(spark, sf_dir, "events").select(F.col("user_id").alias("f"), F.row_number().over(own).alias("k"), "event_id", "event_type", "value"), "calls")


def _result(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    reads, exact = found
    return exact.join(reads, ["func", "pos"], "left").select("func", "pos", "element")


_CALLS_SQL = "b AS (SELECT user_id AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id AS id, event_type AS t, value FROM events), out AS (SELECT DISTINCT f FROM b WHERE value > 350)"


@query(f"""
WITH RECURSIVE {_CALLS_SQL}, c AS (SELECT *, CASE WHEN k <= 3 OR t = 'click' THEN 'add' ELSE t END AS op FROM b WHERE f NOT IN (SELECT f FROM out)),
r(f, k, held, gives, good) AS (SELECT DISTINCT f, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), NULL::BIGINT, true FROM c
UNION ALL SELECT c.f, c.k, CASE WHEN op = 'add' THEN list_append(held, id) WHEN op = 'purchase' THEN held[:c.k % 3] || [id] || held[c.k % 3 + 2:] WHEN op = 'error' THEN held[2:] WHEN op = 'signup' THEN [id] || held ELSE held END,
CASE op WHEN 'view' THEN held[c.k % 7 + 1] WHEN 'purchase' THEN held[c.k % 3 + 1] WHEN 'error' THEN held[1] END, good AND (op <> 'purchase' OR len(held) > c.k % 3) FROM r JOIN c ON c.f = r.f AND c.k = r.k + 1)
SELECT f AS func, CAST(k AS INTEGER) AS pos, gives AS element FROM r WHERE k > 0 AND f NOT IN (SELECT f FROM r WHERE NOT good)
""")
def local_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which element each call on a user's list gives: added, set and read by index, put in front, taken from the front."""
    op = F.when((F.col("k") <= 3) | (F.col("event_type") == "click"), "add").when(F.col("event_type") == "view", "get").when(F.col("event_type") == "purchase", "set").when(F.col("event_type") == "error", "removeFirst").otherwise("addFirst")
    element = F.struct(F.col("event_id").alias("value"), F.lit(None).cast("string").alias("literal"), F.lit(False).alias("whole"))
    args = F.when(op.isin("add", "addFirst"), F.array(element)).when(op == "get", F.array(_literal(F.col("k") % 7, True))).when(op == "set", F.array(_literal(F.col("k") % 3, True), element)).otherwise(F.expr(f"cast(array() as {containers.ARGS})"))
    return _result(_replayed(_calls(spark, sf_dir), "java.util.LinkedList", op, args))


@query(f"""
WITH RECURSIVE {_CALLS_SQL}, c AS (SELECT *, 'key' || k % 4 AS key, sum(CASE WHEN t = 'signup' AND value > 30 THEN 1 ELSE 0 END) OVER (PARTITION BY f ORDER BY k) AS era FROM b WHERE f NOT IN (SELECT f FROM out)),
d AS (SELECT *, row_number() OVER (PARTITION BY f, era, key ORDER BY k) AS j FROM c WHERE NOT (t = 'signup' AND value > 30)),
r(f, era, key, j, k, held, gives) AS (SELECT DISTINCT f, era, key, CAST(0 AS BIGINT), NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM d
UNION ALL SELECT d.f, d.era, d.key, d.j, d.k, CASE t WHEN 'click' THEN id WHEN 'error' THEN NULL WHEN 'purchase' THEN coalesce(held, id) ELSE held END, CASE t WHEN 'signup' THEN coalesce(held, id) ELSE held END FROM r JOIN d ON d.f = r.f AND d.era = r.era AND d.key = r.key AND d.j = r.j + 1)
SELECT f AS func, CAST(k AS INTEGER) AS pos, gives AS element FROM r WHERE j > 0 UNION ALL SELECT f, CAST(k AS INTEGER), NULL FROM c WHERE t = 'signup' AND value > 30
""")
def local_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which element each call on a user's map gives: put, put if absent, removed, cleared, read with a default."""
    clears = (F.col("event_type") == "signup") & (F.col("value") > 30)
    op = F.when(clears, "clear").when(F.col("event_type") == "click", "put").when(F.col("event_type") == "view", "get").when(F.col("event_type") == "purchase", "putIfAbsent").when(F.col("event_type") == "error", "remove").otherwise("getOrDefault")
    element = F.struct(F.col("event_id").alias("value"), F.lit(None).cast("string").alias("literal"), F.lit(False).alias("whole"))
    key = _literal(F.concat(F.lit("key"), (F.col("k") % 4).cast("string")), False)
    args = F.when(clears, F.expr(f"cast(array() as {containers.ARGS})")).when(op.isin("get", "remove"), F.array(key)).otherwise(F.array(key, element))
    return _result(_replayed(_calls(spark, sf_dir), "java.util.HashMap", op, args))


@query("""
WITH RECURSIVE n AS (SELECT max(user_id) + 1 AS n FROM events), ev AS (SELECT event_id AS pos, user_id AS o, event_type AS t, CASE WHEN event_type = 'purchase' THEN (user_id * 7 + 3) % n END AS result FROM events, n),
adds AS (SELECT o, 'sql' AS l, pos, 1 AS s FROM ev WHERE t = 'error' UNION ALL SELECT o, 'web', pos, 1 FROM ev WHERE t = 'click' AND o % 3 = 0 UNION ALL SELECT o, 'safe', pos, 1 FROM ev WHERE t = 'signup' AND o % 5 = 1),
gone AS (SELECT o, 'web' AS l, pos FROM ev WHERE t = 'error' UNION ALL SELECT o, 'sql', pos FROM ev WHERE t = 'signup' UNION ALL SELECT o, 'safe', pos FROM ev WHERE t = 'view'),
a(o, l, q) AS (SELECT o, l, pos FROM adds UNION SELECT h.result, a.l, h.pos FROM a JOIN ev h ON h.o = a.o AND h.result IS NOT NULL AND h.pos > a.q AND NOT EXISTS (SELECT 1 FROM gone g WHERE g.o = a.o AND g.l = a.l AND g.pos > a.q AND g.pos <= h.pos)),
k AS (SELECT ev.pos, a.l, max(a.q) AS q, ev.o FROM ev JOIN a ON a.o = ev.o AND a.q < ev.pos GROUP BY ALL)
SELECT pos AS call, l AS label FROM k WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.o = k.o AND g.l = k.l AND g.pos > k.q AND g.pos < k.pos)
""")
def receiver_side_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What labels a user has when an event begins: events set and take away, purchases hand all to another user."""
    events = table(spark, sf_dir, "events")
    n = events.agg(F.max("user_id") + 1).first()[0]
    calls = events.select(F.col("event_id").alias("call"), F.col("event_id").alias("pos"), F.col("user_id").alias("object"), F.when(F.col("event_type") == "purchase", (F.col("user_id") * 7 + 3) % n).alias("result"))
    t = F.col("event_type")
    remove = F.when(t == "error", F.array(F.lit("web"))).when(t == "signup", F.array(F.lit("sql"))).when(t == "view", F.array(F.lit("safe")))
    add = F.when(t == "error", F.array(F.lit("sql"))).when((t == "click") & (F.col("user_id") % 3 == 0), F.array(F.lit("web"))).when((t == "signup") & (F.col("user_id") % 5 == 1), F.array(F.lit("safe")))
    return receiver_labels.labels_at_calls(calls, events.select(F.col("event_id").alias("call"), F.lit(0).alias("nth"), remove.alias("remove"), add.alias("add")))


@query("""
WITH a AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS access, l_returnflag = 'R' AS is_load, 'base' || l_suppkey % 5 AS base, l_partkey AS idx, CASE WHEN l_linestatus = 'F' THEN l_linenumber END AS constant FROM lineitem),
m AS (SELECT *, 'session' AS rule_id, 'web' AS kind FROM a WHERE is_load AND regexp_matches(base, '^base[12]$') UNION ALL SELECT *, 'direct', 'generic' FROM a WHERE NOT is_load AND constant IS NULL UNION ALL SELECT *, 'any', 'sql' FROM a WHERE base = 'base3')
SELECT 'sink:' || access || ':' || rule_id || ':index' AS node, 'value:' || idx AS value, rule_id, kind FROM m
""")
def index_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices that end in a sink: lines read or write a container at their part."""
    rules = spark.createDataFrame([("session", "python", "web", True, False, "^base[12]$", None), ("direct", None, "", None, None, None, True), ("any", None, "sql", True, True, "^base3$", False), ("other", "go", "sql", True, True, None, False)], "rule_id string, language string, kind string, on_load boolean, on_store boolean, base_regex string, direct_only boolean")
    access = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").select(access.alias("access"), F.lit("python").alias("language"), F.concat(F.lit("base"), (F.col("l_suppkey") % 5).cast("string")).alias("base_name"), F.col("l_partkey").alias("index"), (F.col("l_returnflag") == "R").alias("is_load"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("constant"))
    return flow.index_sinks(rows, rules)


@query("""
SELECT 'sink:' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || ':' || CASE l_linenumber WHEN 2 THEN 'mail' ELSE 'brand' END || ':member=f' || l_linenumber AS node, 'value:' || l_suppkey AS value, CASE l_linenumber WHEN 2 THEN 'mail' ELSE 'brand' END AS rule_id, CASE l_linenumber WHEN 2 THEN 'web' ELSE 'generic' END AS kind FROM lineitem
JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 2 OR l_linenumber = 3 AND p_brand LIKE '%1'
""")
def field_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values written to fields that rules name: a line writes its supplier to the field of its number, owned by its part."""
    rules = spark.createDataFrame([("mail", "f2", None, None, "web"), ("brand", "f3", None, "1$", None), ("none", "f4", "Nobody", None, "sql")], "rule_id string, field string, owner string, owner_regex string, kind string")
    access = F.concat_ws("-", *(F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    accesses = written(lines.select(access.alias("access"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("field"), F.array("p_brand").alias("owners"), F.col("l_suppkey").alias("value")), "accesses")
    return flow.field_nodes(calls.field_matches(accesses.select("access", "field", "owners"), rules.drop("kind")), accesses.select("access", "field", "value"), rules.select("rule_id", "kind"), "sink")


@query("""
WITH f AS (SELECT p_partkey AS f, p_size % 5 AS params, p_size % 2 = 1 AND p_size % 5 > 0 AS method, p_brand FROM part), v AS (SELECT *, params - CASE WHEN method THEN 1 ELSE 0 END AS shown, CASE WHEN method THEN 1 ELSE 0 END AS shift FROM f),
x AS (SELECT f, 'handler' AS rule_id, 'web' AS kind, 'arg' || k AS port, 'formal:' || f || ':' || (k + shift) AS t FROM v, LATERAL (SELECT unnest(range(0, shown)) AS k) WHERE p_brand LIKE '%3'
UNION ALL SELECT f, 'handler', 'generic', 'receiver', 'formal:' || f || ':0' FROM v WHERE method AND p_brand LIKE '%3' UNION ALL SELECT f, 'maker', 'generic', 'return', 'return:' || f FROM v WHERE p_brand LIKE '%#2%' UNION ALL SELECT f, 'maker', 'sql', 'arg1', 'formal:' || f || ':' || (1 + shift) FROM v WHERE p_brand LIKE '%#2%' AND shown > 1)
SELECT 'source:' || f || ':' || rule_id || ':' || port AS node, t AS port, rule_id, kind FROM x
""")
def function_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and results that definitions make sources: parts are functions, named by their brand."""
    rules = spark.createDataFrame([("handler", None, None, "3$", None), ("maker", None, "#2", None, None)], "rule_id string, exact string, contains string, regex string, params int")
    ports = spark.createDataFrame([("handler", "args_from0", "web"), ("handler", "receiver", ""), ("maker", "return", None), ("maker", "arg1", "sql")], "rule_id string, port string, kind string")
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"), F.col("p_brand").alias("name"), (F.col("p_size") % 5).cast("int").alias("params"), ((F.col("p_size") % 2 == 1) & (F.col("p_size") % 5 > 0)).alias("receiver"))
    return flow.function_nodes(calls.function_matches(own.select("function", "name", "params"), rules), own.select("function", "params", "receiver"), ports, "source")


@query("""
WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), w AS (SELECT o, p, row_number() OVER (PARTITION BY o ORDER BY p) - 1 AS nth, count(*) OVER (PARTITION BY o) AS n FROM l),
h AS (SELECT w.*, CASE WHEN p_size > 5 THEN '{"physicalLocation":{"artifactLocation":{"uri":"src/' || p_type || '"},"region":{"startLine":' || greatest(p_partkey, 1) || '}},"message":{"text":"' || p_brand || '"}}' END AS loc FROM w JOIN part ON p_partkey = p),
g AS (SELECT o, n, string_agg('{"location":' || loc || '}', ',' ORDER BY nth) AS steps, max(CASE WHEN nth = 0 THEN loc END) AS source, max(CASE WHEN nth = n - 1 THEN loc END) AS sink, min(p) AS a, max(p) AS b FROM h GROUP BY ALL)
SELECT o AS place, a AS source_node, b AS sink_node, '{"ruleId":"out","level":"error","message":{"text":"value of in reaches out"},"locations":[' || coalesce(sink, '{"physicalLocation":{"artifactLocation":{"uri":"order"},"region":{"startLine":' || greatest(o, 1) || '}},"message":{"text":""}}') || '],"relatedLocations":[' || coalesce(source, '')
|| '],"codeFlows":[{"threadFlows":[{"locations":[' || coalesce(steps, '') || ']}]}],"properties":{"sourceRuleId":"in","sinkRuleId":"out","sourceKind":"web","sinkKind":"sql","analysisComplete":' || (o % 2 = 0) || ',"queryCompleteness":"' || CASE WHEN o % 2 = 0 THEN 'complete' ELSE 'context_limit' END || '"}}' AS value FROM g
""")
def sarif_thread_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with their ways as SARIF results: an order's parts are a way, small parts have no place."""
    lines, k = table(spark, sf_dir, "lineitem"), F.col("o")
    ways = lines.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_set("l_partkey")).alias("path"))
    found = ways.select(F.lit("in").alias("source_rule_id"), F.lit("out").alias("sink_rule_id"), F.lit("web").alias("source_kind"), F.lit("sql").alias("sink_kind"), F.array_min("path").alias("source_node"), F.array_max("path").alias("sink_node"), F.concat(F.lit("order:"), k.cast("string")).alias("location"), "path", F.when(k % 2 == 0, "complete").otherwise("context_limit").alias("completeness"))
    places = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("node"), F.concat(F.lit("src/"), "p_type").alias("uri"), F.col("p_partkey").cast("int").alias("line"), F.col("p_brand").alias("label"))
    return reports.taint_results(found, places).select(F.substring_index("location", ":", -1).cast("long").alias("place"), "source_node", "sink_node", "value")
