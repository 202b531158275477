"""Operating-system packages x distribution advisories: fix states by CVE, inheritance, source packages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import risk, versions
from factloom.session import ship, written

PACKAGE_DDL = "data_keys array<string>, binary string, source string, version string"
STATEMENT_DDL = "data_key string, source string, advisory string, cves array<string>, severity string, fixed_version string, state string"
#: Fix states, the best first.
STATES = ("fixed", "affected", "fix_deferred", "will_not_fix", "not_affected")


def flavor(version: Column) -> Column:
    """RPM builds that only compare among themselves."""
    return F.when(F.lower(version).contains("ksplice"), "ksplice").when(F.lower(version).contains("fips"), "fips").otherwise("regular")


def _older(keys: pd.Series, installed: pd.Series, fixed: pd.Series) -> pd.Series:
    out = []
    for k, a, b in zip(keys, installed, fixed, strict=True):
        scheme = versions.scheme_of(k or "")
        x, y = versions.key(scheme, a), versions.key(scheme, b)
        out.append(x is not None and (y is None or x < y))
    return pd.Series(out)


def collapse(packages: DataFrame) -> DataFrame:
    """Binary packages by source and version, with the sorted binaries."""
    source = F.coalesce("source", "binary")
    return packages.groupBy("data_keys", source.alias("source"), "version").agg(F.array_sort(F.collect_set("binary")).alias("binaries"))


def findings(packages: DataFrame, statements: DataFrame) -> DataFrame:
    """(source, version, cve, severity, advisories, fixed_version, state, binaries). data_keys are ordered: the first is the
    distribution's own data, later ones are its parent's, from which only statements without a fix are taken, and only for
    CVEs that the own data doesn't mention for that package."""
    ship(packages.sparkSession)
    own = collapse(packages).select("*", F.posexplode("data_keys").alias("place", "data_key"))
    flat = statements.where("state <> 'not_affected' or state is null").select("data_key", "source", "advisory", F.explode("cves").alias("cve"), "severity", "fixed_version", F.coalesce("state", F.lit("affected")).alias("state"))
    joined = own.join(flat, ["data_key", "source"])
    same = ~F.col("data_key").rlike("^(rhel|centos|rocky|almalinux|ol|amzn|fedora)") | F.col("fixed_version").isNull() | (flavor(F.col("version")) == flavor(F.col("fixed_version")))
    older = F.pandas_udf(_older, "boolean")("data_key", "version", "fixed_version")
    hits = written(joined.where(same).withColumn("__older", older).where("__older").drop("__older"), "os-hits")
    mentioned = own.where("place = 0").join(statements.select("data_key", "source", F.explode("cves").alias("cve")), ["data_key", "source"]).select("source", "version", "cve").distinct()
    inherited = hits.where("place > 0 and state <> 'fixed'").join(mentioned, ["source", "version", "cve"], "left_anti")
    every = hits.where("place = 0").unionByName(inherited)
    best = risk.choose(F.col("state"), {s: i for i, s in enumerate(STATES)}, len(STATES))
    rank = risk.choose(F.lower("severity"), risk.SEVERITY_RANK, 0)
    out = every.groupBy("source", "version", "cve", "binaries").agg(F.max(rank).alias("r"), F.array_sort(F.collect_set("advisory")).alias("advisories"), F.max("fixed_version").alias("fixed_version"), F.min(best).alias("b"))
    names = lambda xs: F.array(*map(F.lit, xs))
    return out.select("source", "version", "cve", F.element_at(names(("low", "medium", "high", "critical")), F.col("r") + 1).alias("severity"), "advisories", "fixed_version", F.get(names(STATES), F.col("b")).alias("state"), "binaries")


def prefer_source(source_findings: DataFrame, binary_findings: DataFrame) -> DataFrame:
    """Findings by source package, and those by binary package (binary, cve) that no source finding covers."""
    covered = source_findings.select(F.explode("binaries").alias("binary"), "cve").distinct()
    return binary_findings.join(covered, ["binary", "cve"], "left_anti")
