"""Deployment and build files as rows: Kubernetes objects, service definitions, compile commands, reachable headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import graph


def kubernetes(files: DataFrame) -> DataFrame:
    """(path, kind, name, images, ports) of the objects in Kubernetes files(path, content), one YAML document each."""
    docs = files.select("path", F.explode(F.split("content", r"(?m)^---\s*$")).alias("doc"))
    top = lambda k: F.nullif(F.regexp_extract("doc", rf"(?m)^{k}:\s*[\"']?([\w.-]+)", 1), F.lit(""))
    name = F.nullif(F.regexp_extract("doc", r"(?m)^metadata:\s*\n(?:[ \t]+[^\n]*\n)*?[ \t]+name:\s*[\"']?([\w.-]+)", 1), F.lit(""))
    every = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all("doc", F.lit(p), 1)))
    out = docs.select("path", top("kind").alias("kind"), name.alias("name"), every(r"(?m)^\s*-?\s*image:\s*[\"']?([^\s\"']+)").alias("images"), every(r"(?m)^\s*-?\s*(?:containerPort|port):\s*(\d+)").alias("ports"))
    return out.where("kind is not null and name is not null")


def protocol_services(files: DataFrame) -> DataFrame:
    """(path, method, request, response) of .proto files: method is package.Service/Method."""
    text = F.regexp_replace("content", r"//[^\n]*|(?s:/\*.*?\*/)", "")
    package = F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    blocks = files.select("path", package.alias("package"), F.explode(F.regexp_extract_all(text, F.lit(r"\bservice\s+\w+\s*\{(?:[^{}]|\{[^{}]*\})*\}"), 0)).alias("block"))
    rpcs = blocks.select("path", "package", F.regexp_extract("block", r"service\s+(\w+)", 1).alias("service"), F.explode(F.regexp_extract_all("block", F.lit(r"rpc\s+\w+\s*\([^)]*\)\s*returns\s*\([^)]*\)"), 0)).alias("rpc"))
    part = lambda n: F.regexp_extract("rpc", r"rpc\s+(\w+)\s*\(\s*(?:stream\s+)?([\w.]+)\s*\)\s*returns\s*\(\s*(?:stream\s+)?([\w.]+)", n)
    full = F.concat(F.when(F.col("package") != "", F.concat("package", F.lit("."))).otherwise(""), "service", F.lit("/"), part(1))
    return rpcs.select("path", full.alias("method"), part(2).alias("request"), part(3).alias("response"))


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(file, includes, defines) of a compile command database."""
    rows = spark.read.schema("directory string, file string, command string, arguments array<string>").option("multiLine", "true").json(path)
    words = F.coalesce("arguments", F.filter(F.split("command", r"\s+"), lambda w: w != ""))
    flags = lambda letter: F.transform(F.filter(words, lambda w: w.rlike(f"^-{letter}.")), lambda w: F.substring(w, F.lit(3), F.length(w)))
    whole = F.when(F.startswith("file", F.lit("/")), F.col("file")).otherwise(F.concat_ws("/", "directory", "file"))
    return rows.where("file is not null").select(whole.alias("file"), flags("I").alias("includes"), flags("D").alias("defines"))


def headers(files: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(path, depth) of the C files that roots(path) include, directly or through others. Names are looked up beside the
    including file first and below any folder otherwise; a name that several files have is left out."""
    named = files.select("path", F.explode(F.regexp_extract_all("content", F.lit(r'(?m)^\s*#\s*include\s*["<]([^">]+)[">]'), 1)).alias("name"))
    here = named.select(F.col("path").alias("src"), "name", F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), F.col("name")).alias("dst"))
    beside = here.join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    rest = here.join(beside.select("src", "name"), ["src", "name"], "left_anti").select("src", F.element_at(F.split("name", "/"), -1).alias("base"))
    only = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("dst")).where("n = 1").select("base", "dst")
    edges = beside.select("src", "dst").unionByName(rest.join(only, "base").select("src", "dst"))
    found, _ = graph.reach(edges, roots.select(F.col("path").alias("node")), depth)
    return found.where("depth > 0").select(F.col("node").alias("path"), "depth")
