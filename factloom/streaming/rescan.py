"""Incremental scans: facts are kept by path and content hash, only new and changed files are parsed again.

A scan has a number and a name of its own. Facts are written below the name first, then one row per file that says which
name holds its facts. A scan that fails between the two leaves facts that no row names: they are never read, and the next
scan has another name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.rows import snapshot_plan


class FactStore:
    """Facts below a folder: units(path, sha256, version, scan, live) and facts by scan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def history(self) -> DataFrame:
        """What every scan noted of every file, those that are gone as well."""
        try:
            return self.spark.read.parquet(f"{self.folder}/units")
        except AnalysisException:
            return self.spark.createDataFrame([], "path string, sha256 string, version long, scan string, live boolean")

    def units(self) -> DataFrame:
        last = F.max_by(F.struct("sha256", "version", "scan", "live"), "version")
        return self.history().groupBy("path").agg(last.alias("u")).select("path", "u.*").where("live")

    def plan(self, files: DataFrame) -> DataFrame:
        """(path, status) of files(path, sha256) against what is stored."""
        return snapshot_plan(self.units(), files, "path", "sha256")

    def update(self, files: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
        """Parse what is new or changed in files(path, sha256, ...) and note what went; returns counts by status."""
        plan = self.plan(files.select("path", "sha256")).cache()
        counts = {r.status: r["count"] for r in plan.groupBy("status").count().collect()}  # four rows at most
        todo = files.join(plan.where("status in ('added', 'reparsed')").select("path"), "path", "left_semi")
        gone = plan.where("status = 'removed'").select("path")
        if sum(counts.get(s, 0) for s in ("added", "reparsed", "removed")):
            self.commit(todo, gone, parse)
        plan.unpersist()
        return counts

    def commit(self, todo: DataFrame, gone: DataFrame | None, parse: Callable[[DataFrame], DataFrame], scan: str | None = None) -> None:
        """Parse todo(path, sha256, ...) and make it, and that gone(path) went, the newest scan. A scan of the same name
        replaces itself."""
        scan = scan or uuid.uuid4().hex
        version = self.history().agg(F.max("version")).first()[0] or 0
        parse(todo).write.mode("overwrite").parquet(f"{self.folder}/facts/scan={scan}")
        row = lambda sha, live: [sha.cast("string").alias("sha256"), F.lit(version + 1).cast("long").alias("version"), F.lit(scan).alias("scan"), F.lit(live).alias("live")]
        changed = todo.select("path", *row(F.col("sha256"), True))
        if gone is not None:
            changed = changed.unionByName(gone.select("path", *row(F.lit(None), False)))
        changed.write.mode("append").parquet(f"{self.folder}/units")

    def facts(self) -> DataFrame:
        """The facts of the files as they are now."""
        return self.spark.read.parquet(f"{self.folder}/facts").join(self.units().select("path", "scan"), ["path", "scan"], "left_semi")


def watch(spark: SparkSession, source: str, schema: str, store: FactStore, parse: Callable[[DataFrame], DataFrame], checkpoint: str):
    """A stream over a folder of Parquet rows (path, sha256, ...): each batch is parsed and added; nothing is removed, as a
    batch holds new files only. Returns the query, which ends when all that is there is read."""

    def take(batch: DataFrame, number: int) -> None:
        fresh = batch.join(store.units().select("path", "sha256"), ["path", "sha256"], "left_anti")
        if not fresh.isEmpty():
            store.commit(fresh, None, parse, f"batch-{number}")

    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take).trigger(availableNow=True).start()
