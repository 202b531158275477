"""The engine's operators applied to the supplied tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import risk
from factloom.operators import graph, matching, rows
from factloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def values(rows_: list[tuple]) -> str:
    """A VALUES list for both engines."""
    cell = lambda v: "NULL" if v is None else "TRUE" if v is True else "FALSE" if v is False else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows_)


# --- scans over text -------------------------------------------------------------------------------------------------


# --- rules over facts ------------------------------------------------------------------------------------------------
#: rule, exact, contains, pattern on the event's type, lowest and highest value


@query("""
WITH a AS (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS arity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
p AS (SELECT o_orderkey, arity, CASE WHEN o_orderpriority LIKE '1%' THEN 'args_from2' WHEN o_orderpriority LIKE '2%' THEN 'args1..=3' ELSE 'arg0' END AS port FROM a)
SELECT o_orderkey, unnest(CASE port WHEN 'args_from2' THEN list_transform(range(2, arity), lambda i: 'arg' || i) WHEN 'args1..=3' THEN list_transform(range(1, least(4, arity)), lambda i: 'arg' || i) ELSE [port] END) AS port FROM p
""")
def port_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variadic ports clipped to the number of lines of an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    port = F.when(F.startswith("o_orderpriority", F.lit("1")), "args_from2").when(F.startswith("o_orderpriority", F.lit("2")), "args1..=3").otherwise("arg0")
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.select("o_orderkey", F.explode(matching.expand_ports(port, F.coalesce("n", F.lit(0)))).alias("port"))


@query("""
SELECT p_brand, p_partkey, p_name, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1
""")
def last_wins_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last definition of each brand."""
    return rows.last_wins(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name", "p_size"), "p_brand", "p_partkey")


@query("""
WITH n AS (SELECT c_name AS full_name, split_part(c_name, '#', 2) AS simple FROM customer UNION ALL SELECT s_name, split_part(s_name, '#', 2) FROM supplier)
SELECT simple, min(full_name) AS full_name FROM n GROUP BY simple HAVING count(*) = 1
""")
def unique_simple_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last name segments that only one customer or supplier has."""
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("full_name")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("full_name")))
    return rows.unique_names(names.withColumn("simple", F.split_part("full_name", F.lit("#"), F.lit(2))), "simple", ["full_name"])


# --- graph queries: customer -> order -> part -> supplier --------------------------------------------------------------
EDGES_SQL = """
e AS (SELECT DISTINCT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
UNION SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)
"""
SOURCES_SQL = "SELECT 'c' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'"
SINKS_SQL = "SELECT 's' || s_suppkey AS node FROM supplier"


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    out = orders.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    out = out.unionByName(lines.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst")))
    return out.unionByName(lines.select(name("p", "l_partkey").alias("src"), name("s", "l_suppkey").alias("dst")))


def trade_ends(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return sources, table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node"))


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
r(node, depth) AS ({SOURCES_SQL.replace(" AS node", " AS node, 0 AS depth")} UNION SELECT dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 2)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node
""")
def reach_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sources reach in two steps."""
    found, _ = graph.reach(trade_edges(spark, sf_dir), trade_ends(spark, sf_dir)[0], 2, probe=False)
    return found.select("node", F.col("depth").cast("long").alias("depth"))


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
f(node, depth) AS ({SOURCES_SQL.replace(" AS node", " AS node, 0 AS depth")} UNION SELECT dst, depth + 1 FROM f JOIN e ON src = node WHERE depth < 3),
b(node, depth) AS ({SINKS_SQL.replace(" AS node", " AS node, 0 AS depth")} UNION SELECT src, depth + 1 FROM b JOIN e ON dst = node WHERE depth < 3)
SELECT node, CAST(fd AS BIGINT) AS fwd_depth, CAST(bd AS BIGINT) AS bwd_depth FROM (SELECT node, min(depth) AS fd FROM f GROUP BY node) JOIN (SELECT node, min(depth) AS bd FROM b GROUP BY node) USING (node)
""")
def taint_reach_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on ways from source customers to sink suppliers."""
    sources, sinks = trade_ends(spark, sf_dir)
    found = graph.slice_between(trade_edges(spark, sf_dir), sources, sinks, 3)
    return found.select("node", F.col("fwd_depth").cast("long").alias("fwd_depth"), F.col("bwd_depth").cast("long").alias("bwd_depth"))


@query(f"""
WITH {EDGES_SQL.strip()}, s0 AS ({SOURCES_SQL}),
s1 AS (SELECT dst AS node, min(src) AS p1 FROM e JOIN s0 ON src = node GROUP BY dst),
s2 AS (SELECT dst AS node, min(src) AS p2 FROM e JOIN s1 ON src = node GROUP BY dst),
s3 AS (SELECT dst AS node, min(src) AS p3 FROM e JOIN s2 ON src = node GROUP BY dst)
SELECT s3.node, p1 || '>' || p2 || '>' || p3 || '>' || s3.node AS path FROM s3 JOIN s2 ON s2.node = p3 JOIN s1 ON s1.node = p2
""")
def shortest_dep_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shortest way from the sources to each supplier, the smallest parent first."""
    found = graph.shortest_paths(trade_edges(spark, sf_dir), trade_ends(spark, sf_dir)[0], 3)
    return found.where(F.startswith("node", F.lit("s"))).select("node", F.array_join("path", ">").alias("path"))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
c(node, root) USING KEY (node) AS (SELECT o, o FROM e GROUP BY o UNION
SELECT x.node, x.root FROM (SELECT b.o AS node, min(c.root) AS root FROM c JOIN e a ON a.o = c.node JOIN e b ON b.p = a.p GROUP BY b.o) x JOIN recurring.c AS r ON r.node = x.node WHERE x.root < r.root)
SELECT node, root FROM c
""")
def components_alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, root): the smallest order of each component of orders that share parts, as aliases share ids. Ids stand as nodes
    of their own, so no pairs are made."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"))
    parts = graph.components(edges)  # a part's number is negative: smaller than any order's
    smallest = parts.where("node >= 0").groupBy("root").agg(F.min("node").alias("first"))
    return parts.where("node >= 0").join(smallest, "root").select("node", F.col("first").alias("root"))


@query("""
WITH e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem),
n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT 'nodes' AS metric, count(*) AS value FROM n UNION ALL SELECT 'edges', count(*) FROM e UNION ALL SELECT 'distinct_edges', count(*) FROM (SELECT DISTINCT * FROM e)
UNION ALL SELECT 'source_nodes', count(*) FROM n WHERE node NOT IN (SELECT dst FROM e) UNION ALL SELECT 'sink_nodes', count(*) FROM n WHERE node NOT IN (SELECT src FROM e)
UNION ALL SELECT 'self_loops', count(*) FROM e WHERE src = dst
""")
def component_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the graph."""
    return graph.stats(trade_edges(spark, sf_dir))


# --- ranges, scores, groups --------------------------------------------------------------------------------------------
SIZE_RANGES = [("tiny", None, False, 5, True), ("small", 5, False, 15, False), ("middle", 15, True, 30, True), ("odd", 20, True, 25, False), ("large", 30, False, None, False)]


@query(f"""
WITH r(name, lo, lo_incl, hi, hi_incl) AS (VALUES {values(SIZE_RANGES)})
SELECT p_partkey, name FROM part JOIN r ON (lo IS NULL OR p_size > lo OR (lo_incl AND p_size = lo)) AND (hi IS NULL OR p_size < hi OR (hi_incl AND p_size = hi))
""")
def range_join_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in size ranges with open, closed and missing ends (five ranges are broadcast)."""
    ranges = spark.createDataFrame(SIZE_RANGES, "name string, lo int, lo_incl boolean, hi int, hi_incl boolean")
    inside = rows.in_range(F.col("p_size"), *(F.col(c) for c in ("lo", "lo_incl", "hi", "hi_incl")))
    return table(spark, sf_dir, "part").join(F.broadcast(ranges), inside).select("p_partkey", "name")


@query("""
WITH s AS (SELECT o_custkey, CAST(epoch(o_orderdate) // 86400 AS BIGINT) AS lo FROM orders),
g AS (SELECT *, CASE WHEN lo <= max(lo + 30) OVER (PARTITION BY o_custkey ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY lo, fresh DESC ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT o_custkey, min(lo) AS lo, max(lo + 30) AS hi, count(*) AS n FROM i GROUP BY o_custkey, island
""")
def range_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty-day ranges after each order, merged where they touch."""
    days = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400).cast("long")
    spans = table(spark, sf_dir, "orders").select("o_custkey", days.alias("lo")).withColumn("hi", F.col("lo") + 30)
    return rows.islands(spans, "o_custkey", "lo", "hi")


SEVERITY_OF = {"error": "critical", "purchase": "high", "signup": "medium", "view": "low", "click": "low"}


@query("""
WITH w AS (SELECT event_id, CAST(CASE event_type WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.75 WHEN 'signup' THEN 0.45 ELSE 0.2 END AS FLOAT) AS severity,
CAST(CASE WHEN user_id % 3 = 0 THEN 1.0 WHEN user_id % 3 = 1 THEN 0.7 ELSE 0.6 END AS FLOAT) AS reach,
CAST(0.55 + 0.45 * sqrt(least(value / 500, 1.0)) AS FLOAT) AS exploit, CAST(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.9 END AS FLOAT) AS fix FROM events)
SELECT event_id, CAST(floor(CAST(100 AS FLOAT) * severity * reach * exploit * fix + CAST(0.5 AS FLOAT)) AS INTEGER) AS score FROM w
""")
def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fix-first score with an event's type as severity and its value as exploit probability."""
    reach = risk.reach_weight(F.when(F.col("user_id") % 3 == 0, "reachable").when(F.col("user_id") % 3 == 1, "imported"), F.lit("high"), F.lit(False), F.lit(False))
    exploit = risk.exploit_weight(F.lit(False), F.least(F.col("value") / 500, F.lit(1.0)))
    return table(spark, sf_dir, "events").select("event_id", risk.risk_score(risk.choose(F.col("event_type"), SEVERITY_OF), reach, exploit, F.col("event_id") % 2 == 0).alias("score"))


@query("""
SELECT event_type AS rule_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL
""")
def rule_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by rule and severity, in the order of their first occurrence."""
    found = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule_id"), risk.choose(F.col("event_type"), SEVERITY_OF).alias("severity"), "event_id")
    return rows.stable_groups(found, ["rule_id", "severity"], "event_id")


@query("""
SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS severity, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL
""")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity."""
    found = table(spark, sf_dir, "events").select(risk.choose(F.col("event_type"), SEVERITY_OF).alias("severity"), "event_id")
    return rows.stable_groups(found, ["severity"], "event_id")


@query("""
SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1
""")
def finding_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first finding of each key."""
    return rows.first_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


_PREDICTED = "regexp_matches(text, '[|]|[$]{3}|!!')"
_CONFUSION_SQL = f"""
WITH p AS (SELECT lang, quality = 0 AS actual, {_PREDICTED} AS predicted FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) FILTER (actual AND predicted) AS tp, count(*) FILTER (NOT actual AND predicted) AS fp, count(*) FILTER (actual AND NOT predicted) AS fn, count(*) FILTER (NOT actual AND NOT predicted) AS tn FROM p GROUP BY lang),
m AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr FROM c)
"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").rlike("[|]|[$]{3}|!!").alias("predicted")).join(labels, "doc_id").select("lang", (F.col("quality") == 0).alias("actual"), "predicted")


@query(_CONFUSION_SQL + "SELECT lang, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(fpr, 9) AS fpr, round(2 * precision * recall / nullif(precision + recall, 0), 9) AS f_beta, round(recall - fpr, 9) AS youden FROM m")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule's verdicts against the labels, by language."""
    out = rows.confusion(predictions(spark, sf_dir), ["lang"], F.col("actual"), F.col("predicted"))
    return out.select("lang", "tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "fpr", "f_beta", "youden")))


@query(_CONFUSION_SQL + "SELECT round(avg(recall - fpr), 9) AS score, count(recall - fpr) AS categories FROM m")
def category_mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over categories whose score is defined."""
    out = rows.confusion(predictions(spark, sf_dir), ["lang"], F.col("actual"), F.col("predicted"))
    return out.agg(F.round(F.avg("youden"), 9).alias("score"), F.count("youden").alias("categories"))


# --- snapshots, coverage, comparisons ------------------------------------------------------------------------------------
@query("""
WITH o AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN upper(text) ELSE text END) AS h FROM documents WHERE source <> 'src3'),
n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE source <> 'src7')
SELECT doc_id, CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'removed' WHEN o.h = n.h THEN 'reused' ELSE 'reparsed' END AS status FROM o FULL JOIN n USING (doc_id)
""")
def cache_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second scan would reuse, parse again, add and remove."""
    docs = table(spark, sf_dir, "documents")
    digest = lambda c: F.sha2(c, 256).alias("h")
    old = docs.where("source <> 'src3'").select("doc_id", digest(F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))))
    return rows.snapshot_plan(old, docs.where("source <> 'src7'").select("doc_id", digest(F.col("text"))), "doc_id", "h")


@query("""
WITH c AS (SELECT CASE WHEN quality = 0 AND toxic = 1 THEN 'both' WHEN quality = 0 THEN 'only_left' ELSE 'only_right' END AS side FROM labels WHERE quality = 0 OR toxic = 1)
SELECT side, count(*) AS n FROM c GROUP BY side
""")
def tool_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tools' findings: in both, or in one only."""
    labels = table(spark, sf_dir, "labels")
    return rows.compare_findings(labels.where("quality = 0"), labels.where("toxic = 1"), "doc_id").groupBy("side").agg(F.count("*").alias("n"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS path FROM pages),
parts AS (SELECT page_id, list_filter(string_split(path, '/'), lambda x: x <> '') AS a FROM p),
x AS (SELECT page_id, len(a) AS n, unnest(list_transform(range(1, len(a) + 1), lambda i: array_to_string(a[1:i], '/'))) AS prefix FROM parts)
SELECT prefix, count(*) AS n_pages, max(n) AS deepest FROM x GROUP BY prefix
""")
def prefix_region_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and their ancestors: paths meet on exploded prefixes."""
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", rows.prefixes(path).alias("p"))
    return pages.select(F.size("p").cast("long").alias("n"), F.explode("p").alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n_pages"), F.max("n").alias("deepest"))


# --- order within a key --------------------------------------------------------------------------------------------------
@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS visible FROM events
""")
def store_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last store that an event sees."""
    stored = F.when(F.col("event_type") == "purchase", F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", rows.visible_before("user_id", "event_id", stored).alias("visible"))


@query("""
WITH k AS (SELECT user_id, event_type, max(event_id) AS pos FROM events GROUP BY ALL),
p AS (SELECT user_id, max(pos) FILTER (event_type = 'view') AS cut FROM k GROUP BY user_id),
l AS (SELECT user_id, list_sort(list(event_type) FILTER (event_type <> 'view')) AS labels, list_sort(list(event_type) FILTER (event_type <> 'view' AND pos < coalesce(cut, 0))) AS removed FROM k JOIN p USING (user_id) GROUP BY user_id)
SELECT user_id, array_to_string(coalesce(list_sort(list_filter(coalesce(labels, []), lambda x: NOT list_contains(coalesce(removed, []), x))), []), ',') AS labels FROM l
""")
def label_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sets after a sanitizer: a view removes the labels whose last event came before it."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("at"))
    cut = F.coalesce(F.max(F.when(F.col("event_type") == "view", F.col("at"))), F.lit(0))
    pairs = F.collect_list(F.struct("event_type", "at"))  # five types at most
    out = last.groupBy("user_id").agg(pairs.alias("p"), cut.alias("cut")).withColumn("p", F.filter("p", lambda x: x["event_type"] != "view"))
    labels = F.transform("p", lambda x: x["event_type"])
    removed = F.transform(F.filter("p", lambda x: x["at"] < F.col("cut")), lambda x: x["event_type"])
    return out.select("user_id", F.array_join(risk.apply_labels(labels, removed, F.array().cast("array<string>")), ",").alias("labels"))


# --- joins of call facts -------------------------------------------------------------------------------------------------


