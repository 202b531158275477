"""Findings as JSON, SARIF, DOT, Markdown and frames. Texts are aggregated on the executors and written by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import risk
from factloom.operators import rows
from factloom.session import written

FINDING_DDL = "rule_id string, severity string, message string, path string, line int, col int, cwe array<string>"


def level(severity) -> F.Column:
    return risk.choose(F.lower(severity), {"critical": "error", "high": "error", "medium": "warning"}, "note")


def normal_severity(given, sink_kind) -> F.Column:
    """The given severity, or, where it is blank, the one that the kind of the sink stands for."""
    of_kind = risk.choose(sink_kind, {"critical": "error", "error": "error", "note": "note", "info": "note", "informational": "note"}, "warning")
    return F.when(F.trim(given) != "", given).otherwise(of_kind)


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, value): each rule as a SARIF object."""
    weaknesses = F.explode_outer(F.coalesce("cwe", F.array().cast("array<string>"))).alias("c")
    rules = findings.select("rule_id", "message", weaknesses).groupBy("rule_id").agg(F.min("message").alias("m"), F.array_sort(F.collect_set("c")).alias("cwe"))
    rule = F.struct(F.col("rule_id").alias("id"), F.struct(F.col("m").alias("text")).alias("shortDescription"), F.struct(F.col("cwe").alias("tags")).alias("properties"))
    return rules.select("rule_id", F.to_json(rule).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(path, line, col, rule_id, value): each finding as a SARIF result."""
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level(F.col("severity")).alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))
    return findings.select("path", "line", "col", "rule_id", F.to_json(result).alias("value"))


def _location(uri, line, label) -> F.Column:
    """A place as SARIF has it; lines begin at 1."""
    region = F.struct(F.greatest(F.coalesce(line, F.lit(1)), F.lit(1)).alias("startLine"))
    return F.struct(F.struct(F.struct(uri.alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"), F.struct(F.coalesce(label, F.lit("")).alias("text")).alias("message"))


def taint_results(found: DataFrame, places: DataFrame) -> DataFrame:
    """(source_rule_id, sink_rule_id, location, source_node, sink_node, value): findings of a taint search as SARIF results with
    the way that the value goes: a thread flow over the nodes of `path` that places(node, uri, line, label) knows, the sink as
    the location (or, where its place isn't known, `location` as path:line), the source as related location.

    Nodes without a place, as those of the limit row, leave no step. Ways are as long as searches are deep."""
    key = ["source_rule_id", "sink_rule_id", "location", "source_node", "sink_node"]
    numbered = written(found.withColumn("__id", F.struct(*key)), "findings")
    at = numbered.select("__id", "source_node", "sink_node", F.posexplode("path").alias("nth", "node")).join(places, "node")
    here = _location(F.col("uri"), F.col("line"), F.col("label"))
    step = F.struct("nth", here.alias("location"))
    ways = at.groupBy("__id").agg(F.array_sort(F.collect_list(step)).alias("steps"), F.min(F.when(F.col("node") == F.col("source_node"), here)).alias("source"), F.min(F.when(F.col("node") == F.col("sink_node"), here)).alias("sink"))
    met = numbered.join(ways, "__id", "left")
    split = _location(F.regexp_replace("location", r":\d+$", ""), F.regexp_extract("location", r":(\d+)$", 1).try_cast("int"), F.lit(""))
    flow = F.transform(F.coalesce("steps", F.array().cast("array<struct<nth: int, location: struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int>>, message: struct<text: string>>>>")), lambda s: F.struct(s["location"].alias("location")))
    message = F.concat(F.lit("value of "), "source_rule_id", F.lit(" reaches "), "sink_rule_id")
    properties = F.struct(F.col("source_rule_id").alias("sourceRuleId"), F.col("sink_rule_id").alias("sinkRuleId"), F.col("source_kind").alias("sourceKind"), F.col("sink_kind").alias("sinkKind"), (F.col("completeness") == "complete").alias("analysisComplete"), F.col("completeness").alias("queryCompleteness"))
    result = F.struct(
        F.col("sink_rule_id").alias("ruleId"), level(F.lit("high")).alias("level"), F.struct(message.alias("text")).alias("message"), F.array(F.coalesce("sink", split)).alias("locations"), F.array_compact(F.array("source")).alias("relatedLocations"),
        F.array(F.struct(F.array(F.struct(flow.alias("locations"))).alias("threadFlows"))).alias("codeFlows"), properties.alias("properties"),
    )
    return met.select(*key, F.to_json(result).alias("value"))


def sarif(findings: DataFrame, tool: str = "factloom") -> DataFrame:
    """The lines of a SARIF 2.1.0 log, sorted: one line a rule and one a result, so no row and no task holds the log. The
    written part files, one after the other, are the log."""
    spark = findings.sparkSession
    nothing = F.lit("")
    rules = sarif_rules(findings).select(F.lit(1).alias("o"), F.col("rule_id").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("col"), "rule_id", "value")
    results = sarif_results(findings).select(F.lit(3).alias("o"), "path", "line", "col", "rule_id", "value")
    rows_ = written(rules.unionByName(results).withColumn("n", F.monotonically_increasing_id()), "sarif")
    order = ["o", "path", "line", "col", "rule_id", "n"]
    last = rows_.groupBy("o").agg(F.max(F.struct(*order)).alias("x")).select("o", F.col("x.n").alias("last"))  # two rows
    body = rows_.join(F.broadcast(last), "o").select(*order, F.concat("value", F.when(F.col("n") == F.col("last"), nothing).otherwise(",")).alias("value"))
    head = f'{{"$schema":"https://json.schemastore.org/sarif-2.1.0.json","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":{json.dumps(tool)},"rules":['
    frame = spark.createDataFrame([(0, "", 0, 0, "", 0, head), (2, "", 0, 0, "", 0, ']}},"results":['), (4, "", 0, 0, "", 0, "]}]}")], "o int, path string, line int, col int, rule_id string, n long, value string")
    return frame.unionByName(body).orderBy(*order).select("value")


def system_graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(what, value): each node(id, kind, name, attrs) and each edge(src, dst, kind, confidence, evidence) of a service graph as
    a JSON object, one a row."""
    n = nodes.select(F.lit("node").alias("what"), F.to_json(F.struct("id", "kind", "name", "attrs")).alias("value"))
    return n.unionByName(edges.select(F.lit("edge").alias("what"), F.to_json(F.struct("src", "dst", "kind", "confidence", "evidence")).alias("value")))


def dot(nodes: DataFrame, edges: DataFrame, highlighted: DataFrame | None = None) -> DataFrame:
    """Lines of a DOT graph of nodes(id, label) and edges(src, dst, kind), in order; edges on findings' ways are red."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    if highlighted is not None:
        edges = edges.join(highlighted.select("src", "dst").distinct().withColumn("__hot", F.lit(" color=red")), ["src", "dst"], "left")
    else:
        edges = edges.withColumn("__hot", F.lit(None).cast("string"))
    body = nodes.select(F.lit(1).alias("o"), F.concat(F.lit("  "), quote(F.col("id")), F.lit(" [label="), quote(F.col("label")), F.lit("];")).alias("value"))
    links = edges.select(F.lit(2).alias("o"), F.concat(F.lit("  "), quote(F.col("src")), F.lit(" -> "), quote(F.col("dst")), F.lit(" [label="), quote(F.col("kind")), F.coalesce("__hot", F.lit("")), F.lit("];")).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph facts {"), (3, "}")], "o int, value string")
    return ends.unionByName(body).unionByName(links).orderBy("o", "value").select("value")


def markdown(findings: DataFrame) -> DataFrame:
    """Lines of a Markdown report: counts by severity, then the findings in order."""
    spark = findings.sparkSession
    counts = findings.groupBy("severity").agg(F.count("*").alias("n")).select(F.lit(1).alias("o"), F.format_string("| %s | %d |", "severity", "n").alias("value"))
    each = findings.select(F.lit(3).alias("o"), F.format_string("- `%s` %s:%d:%d %s", "rule_id", "path", "line", "col", F.coalesce("message", F.lit(""))).alias("value"))
    heads = spark.createDataFrame([(0, "# Findings"), (0, "| severity | findings |"), (0, "| --- | --- |"), (2, "")], "o int, value string").withColumn("k", F.monotonically_increasing_id())
    return heads.unionByName(counts.withColumn("k", F.lit(0).cast("long"))).unionByName(each.withColumn("k", F.lit(0).cast("long"))).orderBy("o", "k", "value").select("value")


def frames(findings: DataFrame) -> dict[str, DataFrame]:
    """The sheets of a workbook as frames."""
    numbered = findings.withColumn("ordinal", F.struct("path", "line", "col", "rule_id"))
    return {"Findings": findings.orderBy("path", "line", "col", "rule_id"), "Rule Summary": rows.stable_groups(numbered, ["rule_id", "severity"], "ordinal").orderBy("first").drop("first"), "Summary": rows.stable_groups(numbered, ["severity"], "ordinal").orderBy("first").drop("first")}


def write(findings: DataFrame, folder: str) -> None:
    """All reports below a folder."""
    findings.write.mode("overwrite").json(f"{folder}/json")
    sarif(findings).write.mode("overwrite").text(f"{folder}/sarif")
    markdown(findings).write.mode("overwrite").text(f"{folder}/markdown")
    for name, frame in frames(findings).items():
        frame.write.mode("overwrite").parquet(f"{folder}/frames/{name.lower().replace(' ', '_')}")
