"""Per-function analyses, image layers, deployment files and checkers on the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import checkers, dataflow, rulesets, system_graph, text_rules
from factloom.plans.conformance import query
from factloom.session import table
from factloom.sources import manifests


def instructions(spark: SparkSession, sf_dir: str, kinds: dict[str, str], defines: tuple[str, ...], both: tuple[str, ...] = (), const: dict[str, F.Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Events as instructions of one block: users are functions, every third id is a value. kinds: by event type; defines: the
    kinds that set their value, both: that read it too."""
    kind = F.coalesce(*(F.when(F.col("event_type") == e, k) for e, k in kinds.items()), F.lit("other"))
    value = (F.col("event_id") % 3).cast("int")
    given = F.coalesce(*(F.when(F.col("kind") == k, c) for k, c in (const or {}).items()), F.lit(None)).cast("long")
    rows = table(spark, sf_dir, "events").withColumns({"kind": kind, "v": value})
    insts = rows.select(F.col("user_id").alias("func_id"), F.lit(0).alias("block"), F.col("event_id").cast("int").alias("pos"), "kind", F.when(F.col("kind").isin(*defines, *both), F.col("v")).alias("dst"), F.when(~F.col("kind").isin(*defines), F.col("v")).alias("src"), F.lit(None).cast("string").alias("op"), given.alias("const"))
    return insts, spark.createDataFrame([], dataflow.CFG_DDL)


@query("""
WITH s AS (SELECT user_id, event_id, event_type, event_id % 3 AS v, last_value(CASE event_type WHEN 'error' THEN 'freed' WHEN 'click' THEN 'owned' END IGNORE NULLS) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events)
SELECT user_id AS func_id, event_id AS pos, v AS value, CASE event_type WHEN 'error' THEN 'double_free' ELSE 'use_after_free' END AS problem FROM s WHERE was = 'freed' AND event_type IN ('error', 'view')
""")
def lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses after a release, and second releases."""
    insts, cfg = instructions(spark, sf_dir, {"error": "free", "view": "deref", "click": "alloc"}, ("alloc",))
    return dataflow.lifetimes(insts, cfg).select("func_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"), "problem")


@query("""
WITH s AS (SELECT user_id, event_id, event_type, event_id % 3 AS v, last_value(CASE event_type WHEN 'error' THEN 'null' WHEN 'click' THEN 'nonnull' WHEN 'view' THEN 'nonnull' END IGNORE NULLS) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM events)
SELECT user_id AS func_id, event_id AS pos, v AS value, coalesce(was, 'unknown') AS fact FROM s WHERE event_type = 'view'
""")
def nullness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of values where they are dereferenced."""
    insts, cfg = instructions(spark, sf_dir, {"error": "null", "view": "deref", "click": "alloc"}, ("null", "alloc"))
    return dataflow.nullness(insts, cfg).select("func_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"), "fact")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, value, event_id % 3 AS v, sum(CASE WHEN event_type IN ('click', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
s AS (SELECT *, max(CASE WHEN event_type = 'click' THEN floor(value) END) OVER (PARTITION BY user_id, v, g) AS base, sum(CASE WHEN event_type = 'purchase' THEN 10 ELSE 0 END) OVER (PARTITION BY user_id, v, g ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS adds FROM e)
SELECT user_id AS func_id, event_id AS pos, v AS value, CASE WHEN base IS NULL THEN 'unknown' WHEN base + adds BETWEEN 0 AND 199 THEN 'safe' ELSE 'out_of_bounds' END AS verdict FROM s WHERE event_type = 'view'
""")
def index_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether indices lie within their arrays, by the intervals of their values."""
    insts, cfg = instructions(spark, sf_dir, {"click": "const", "error": "call", "purchase": "add", "view": "index"}, ("const", "call"), ("add",), {"const": F.floor("value"), "add": F.lit(10), "index": F.lit(200)})
    return dataflow.index_safety(insts, cfg).select("func_id", F.col("pos").cast("long").alias("pos"), F.col("value").cast("long").alias("value"), "verdict")


@query("""
WITH f AS (SELECT l_partkey AS p, l_linenumber AS layer, max(l_suppkey) AS data FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity >= 10 GROUP BY ALL), w AS (SELECT l_partkey AS p, max(l_linenumber) AS gone FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10 GROUP BY ALL),
s AS (SELECT p, max(layer) AS layer, arg_max(data, layer) AS data FROM f GROUP BY p)
SELECT 'd/p' || s.p AS path, layer, data FROM s LEFT JOIN w ON w.p = s.p WHERE gone IS NULL OR gone <= layer
""")
def image_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that the layers of an image leave."""
    lines = table(spark, sf_dir, "lineitem")
    path = lambda mark: F.concat(F.lit(mark), F.col("l_partkey").cast("string"))
    files = lines.where("l_returnflag <> 'R' or l_quantity >= 10").groupBy(F.col("l_linenumber").alias("layer"), path("d/p").alias("path")).agg(F.max("l_suppkey").alias("data"))
    gone = lines.where("l_returnflag = 'R' and l_quantity < 10").select(F.col("l_linenumber").alias("layer"), path("d/.wh.p").alias("path"), F.lit(None).cast("long").alias("data")).distinct()
    return manifests.squash(files.unionByName(gone)).select("path", "layer", "data")


@query("""
SELECT n_nationkey AS image, CASE n_nationkey % 3 WHEN 0 THEN 'ubuntu' WHEN 1 THEN 'alpine' ELSE 'debian' END AS distro, CASE n_nationkey % 3 WHEN 0 THEN 'ubuntu:22.04' WHEN 1 THEN 'alpine:3.' || n_nationkey ELSE 'debian:' || n_nationkey END AS data_key FROM nation
""")
def image_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which distribution an image holds."""
    k = F.col("n_nationkey")
    text = k.cast("string")
    path = F.when(k % 3 == 0, "/etc/os-release").when(k % 3 == 1, "/etc/alpine-release").otherwise("/etc/debian_version")
    content = F.when(k % 3 == 0, 'NAME="x"\nID=ubuntu\nVERSION_ID="22.04"\n').when(k % 3 == 1, F.concat(F.lit("3."), text, F.lit(".2\n"))).otherwise(F.concat(text, F.lit(".7\n")))
    return rulesets.distro(table(spark, sf_dir, "nation").select(k.alias("image"), path.alias("path"), content.alias("content"))).select("image", "distro", "data_key")


@query("""
SELECT p_partkey, 'org.ex.B' || replace(p_brand, 'Brand#', '') AS name, 'b1' AS rule_id FROM part WHERE p_brand LIKE 'Brand#1%' UNION ALL SELECT p_partkey, 'java.util.*', 'util' FROM part WHERE p_size % 2 = 0
""")
def java_import_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of packages that rules name."""
    name = F.concat(F.lit("org.ex.B"), F.replace("p_brand", F.lit("Brand#"), F.lit("")))
    content = F.concat(F.lit("package a;\nimport static "), name, F.lit(";\n"), F.when(F.col("p_size") % 2 == 0, "  import java.util.*;\n").otherwise(""))
    files = table(spark, sf_dir, "part").select(F.lit("java").alias("language"), F.col("p_partkey").cast("string").alias("path"), content.alias("content"))
    rules = spark.createDataFrame([("b1", r"^org\.ex\.B1"), ("util", r"^java\.util\.")], "rule_id string, pattern string")
    return text_rules.java_imports(files, rules).select(F.col("path").cast("long").alias("p_partkey"), "name", "rule_id")


@query("""
SELECT 'service:s' || s_suppkey AS id, 'img' || s_nationkey AS image, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey || ':80' END AS ports FROM supplier UNION ALL SELECT 'service:db' || s_suppkey, 'pg', NULL FROM supplier
""")
def compose_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Services of Compose files with image and ports."""
    s = F.col("s_suppkey").cast("string")
    ports = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit('    ports:\n      - "'), s, F.lit(':80"\n'))).otherwise("")
    content = F.concat(F.lit("version: 3\nservices:\n  s"), s, F.lit(":\n    image: img"), F.col("s_nationkey").cast("string"), F.lit("\n"), ports, F.lit("  db"), s, F.lit(":\n    image: pg\nvolumes:\n  x:\n"))
    found = system_graph.compose_services(table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), s).alias("path"), content.alias("content")))
    return found.select("id", F.element_at("attrs", "image").alias("image"), F.try_element_at("attrs", F.lit("ports")).alias("ports"))


@query("""
SELECT 'calls' AS checker_id, 'r1' AS rule_id, user_id AS path, event_id AS line FROM events WHERE event_type = 'click' AND event_id > 0 UNION ALL SELECT 'files', 'r2', user_id, event_id + 1 FROM events WHERE event_type = 'view'
""")
def checker_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkers over the events that they subscribe to; what they may not report is dropped."""
    kind = F.when(F.col("event_type") == "click", "call").when(F.col("event_type") == "view", "file").otherwise("import")
    events = table(spark, sf_dir, "events").select(kind.alias("event"), F.col("user_id").cast("string").alias("path"), F.col("event_id").cast("int").alias("line"))
    report = lambda rule, more: lambda e: e.select(F.lit(rule).alias("rule_id"), F.lit("m").alias("message"), "path", (F.col("line") + more).alias("line"), F.lit(1).alias("col"))

    def broken(_):
        raise RuntimeError("down")

    own = lambda name, event, run: checkers.Checker(name, "frontend", frozenset({"r1", "r2"}), frozenset({event}), run)
    found, _ = checkers.run_all(spark, [own("calls", "call", report("r1", 0)), own("files", "file", report("r2", 1)), own("odd", "import", report("r9", 1)), own("down", "file", broken)], events)
    return found.select("checker_id", "rule_id", F.col("path").cast("long").alias("path"), F.col("line").cast("long").alias("line"))
