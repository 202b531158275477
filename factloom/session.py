"""Session defaults, inputs and the shared folder in which loops cut their lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPO = str(Path(__file__).resolve().parents[1])


def session(name: str = "factloom", master: str | None = None) -> SparkSession:
    """A session with adaptive execution and UTC. What a cluster sets elsewhere stays as it is."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    return (builder.master(master) if master else builder).getOrCreate()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Python workers find this package: beside the driver where they share its folders, and on a cluster in an archive that
    the driver hands out once for each application."""
    context = spark.sparkContext
    context.environment.setdefault("PYTHONPATH", os.pathsep.join(x for x in (REPO, os.environ.get("PYTHONPATH", "")) if x))
    if not context.master.startswith("local") and context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='factloom-')}/factloom", "zip", REPO, "factloom"))


#: Settings for rows that hold whole texts, where a session has Spark's own: bytes in an Arrow batch between Spark and Python.
#: Without them a batch has 10,000 texts, however long they are, and a worker holds it several times.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304")}


def ship_lean(spark: SparkSession) -> None:
    """ship(), for operators that hand whole texts to Python: batches are bounded."""
    ship(spark)
    for name, (default, own) in LEAN.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, own)


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (only where that is unset, as in tests) a new folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.conf.get("factloom.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("factloom.shared.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Bytes of a row group of a written table: a task holds one in memory while it writes.
ROW_GROUP = 16 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket of a dealt table, and buckets at most.
BUCKET_ROWS, BUCKETS = 100_000, 400


def buckets(rows: int, each: int = BUCKET_ROWS) -> int:
    return min(BUCKETS, rows // each + 1)


class Dealt:
    """Distinct rows in a table of the shared folder that is bucketed by the columns `by` and grows by rounds. Joins on these
    columns, or on them and others, with another table of as many buckets move neither; what a round finds is shuffled once, and
    what was known before isn't shuffled again. keys: a row whose keys are there isn't new, whatever else it says."""

    def __init__(self, first: DataFrame, name: str, by: list[str], n: int, keys: list[str] | None = None):
        self.keys = keys or first.columns
        self.spark, self.columns, self.by, self.n, self.round = first.sparkSession, first.columns, by, n, -1
        self.path = shared_folder(self.spark, name)
        self.name = self.path.rsplit("/", 1)[-1].replace("-", "_")
        self.last = self.add(first)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.name).select(*self.columns)

    def add(self, found: DataFrame, moved: bool = True) -> DataFrame:
        """The rows of `found` that weren't there, which now are. moved: they don't stand in their buckets as they come."""
        found = found.select(*self.columns)
        new = (found.repartition(self.n, *self.by) if moved else found).distinct()
        if self.round >= 0:
            new = new.join(self.rows.select(*self.keys), self.keys, "left_anti")
        self.round += 1
        out = new.withColumn("__round", F.lit(self.round)).write.mode("append").partitionBy("__round").bucketBy(self.n, *self.by)
        # buckets by some of a join's columns do for the join
        key = "spark.sql.requireAllClusterKeysForCoPartition"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            out.option("path", self.path).option("parquet.block.size", ROW_GROUP).saveAsTable(self.name)
        finally:
            self.spark.conf.set(key, before)
        self.last = self.spark.table(self.name).where(F.col("__round") == self.round).select(*self.columns)
        return self.last


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that are broadcast take at most so many bytes, counted as JSON; more are joined by shuffles or in parts.
BROADCAST_BYTES = 32 << 20


def row_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows, counted, are small enough."""
    return F.broadcast(df) if row_bytes(df) <= BROADCAST_BYTES else df


def broadcast_parts(df: DataFrame) -> list[DataFrame]:
    """df as broadcasts that are each small enough, for joins without a key: the other side meets them one after the other."""
    n = max(1, -(-row_bytes(df) // BROADCAST_BYTES))
    return [F.broadcast(df if n == 1 else df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) == k)) for k in range(n)]
