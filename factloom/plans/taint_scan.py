"""From source files to findings: parse, match rules on calls, build flow, search witnesses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import matching, taint
from factloom.session import written
from factloom.sources import python_code


def scan(files: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None) -> DataFrame:
    """Findings of files(file_id, path, content). The rule frames come from matching.rules_frame with columns kind and, if
    there are ports, port: a source taints what its call returns, or the port that it names, a sink takes the arguments of
    its call, all or those that its ports name, a sanitizer takes its kind from what its call returns."""
    rows = written(python_code.facts(files), "facts")
    calls = written(python_code.call_sites(rows), "calls")
    edges = python_code.flow_edges(rows)
    ports = rows.where("what = 'arg'").select(F.col("a").alias("node"), F.col("b").alias("at"), F.coalesce(F.concat(F.lit("named:"), F.col("name")), F.concat(F.lit("arg"), F.col("number").cast("string"))).alias("is"))
    return search(calls, edges, ports, sources, sinks, sanitizers)


def search(calls: DataFrame, edges: DataFrame, ports: DataFrame, sources: DataFrame, sinks: DataFrame, sanitizers: DataFrame | None = None) -> DataFrame:
    """Findings along edges(src, dst, kind, site, remove, add) between calls (as call_sites(), node: what the call returns), whose
    ports(node, at, is) name the nodes that their arguments flow into."""

    def met(rules: DataFrame) -> DataFrame:
        """Calls with the rule they match, its kind and the port that it names, variadic ones expanded."""
        wide = rules if "port" in rules.columns else rules.withColumn("port", F.lit(None).cast("string"))
        found = matching.match_calls(calls, wide.drop("kind", "port").distinct()).join(wide.select("rule_id", "kind", "port").distinct(), "rule_id")
        return found.withColumn("port", F.explode(F.when(F.col("port").isNull(), F.array(F.col("port"))).otherwise(matching.expand_ports(F.col("port"), F.col("arg_count")))))

    began = met(sources)
    found = began.where("port is null or port = 'return'").select("node", "rule_id", "kind")
    given = began.where("port <> 'return'").join(ports.withColumnRenamed("is", "port"), ["node", "port"])
    # what a call writes to an argument is in the value behind it from then on
    behind = edges.where("kind = 'flow'").select(F.col("src").alias("value"), F.col("dst").alias("at"))
    found = found.unionByName(given.join(behind, "at").select(F.col("value").alias("node"), "rule_id", "kind"))
    to = met(sinks)
    where = F.concat_ws(":", "path", F.col("line").cast("string"))
    meets = F.col("port").isNull() | (F.col("port") == F.col("is"))
    sink_nodes = to.join(ports, "node").where(meets).select(F.col("at").alias("node"), "rule_id", "kind", where.alias("location"))
    if sanitizers is not None:
        clean = met(sanitizers).groupBy(F.col("node").alias("dst")).agg(F.array_sort(F.collect_set("kind")).alias("taken"))
        edges = edges.join(clean, "dst", "left").withColumn("remove", F.coalesce("taken", "remove")).select("src", "dst", "kind", "site", "remove", "add")
    return taint.findings(written(edges, "edges"), written(found.distinct(), "sources"), written(sink_nodes.distinct(), "sinks"))
