"""Exact deduplication as a stateful stream (operator 5).

Texts are equal when they are identical after each run of white space [\\x20\\x09-\\x0D]+ is one space. A first pass over
the text writes digest, document id and content locator (file and row) of every row to the shared folder. Structured
Streaming reads those rows and keeps, keyed by digest, without a watermark and so without expiry, the smallest id with
its locator and the number of rows; the state lives in RocksDB on the executors' disks, with snapshots in the shared
folder. New files can be added to the same state later on (see DigestState).

Hits, that is rows whose digest has more than one row, are read again by their digest and compared over all their bytes;
equal groups are combined in each task before they are shuffled, so a large group moves as one row a task. If a digest
held different texts, its rows would be grouped anew by their whole text.

Cases: null counts as empty, so null and empty and blank texts make up one or two groups ('' and ' '); null ids come
before others; of rows with the same text and id the one with the first locator stays; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import shared_folder, ship, small, written

#: State on disk. A store is closed when its task is done, memory is bounded for all stores of an executor, and log files
#: aren't preallocated, which takes megabytes for every partition however little it holds.
_STORE = "spark.sql.streaming.stateStore"
ROCKS = {
    f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{_STORE}.unloadOnCommit": "true",
    f"{_STORE}.rocksdb.allowFAllocate": "false",
    f"{_STORE}.rocksdb.boundedMemoryUsage": "true",
    f"{_STORE}.rocksdb.maxMemoryUsageMB": "96",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame) -> DataFrame:
    """docs as read from files, so that a row's file and place can be named; other frames are written first."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema  # noqa: B018
        return docs
    except AnalysisException:
        return written(docs, "documents")


def locator(docs: DataFrame) -> tuple[Column, Column]:
    """File and place of a row of located docs as two longs. A file is a 64-bit hash of its path, under the first seed that
    gives all files of docs different ones."""
    meta = docs.metadataColumn("_metadata")
    paths = docs.select(meta.getField("file_path").alias("path")).distinct()
    seed = 0
    while True:
        file = lambda path: F.xxhash64(path, F.lit(seed))  # noqa: B023
        if paths.agg((F.count("path") == F.countDistinct(file(F.col("path")))).alias("ok")).first().ok:
            return file(meta.getField("file_path")), meta.getField("row_index")
        seed += 1


def path_and_row(docs: DataFrame) -> tuple[Column, Column]:
    meta = docs.metadataColumn("_metadata")  # this one, whatever columns docs has
    return meta.getField("file_path"), meta.getField("row_index")


def without(docs: DataFrame, dropped: DataFrame, places: tuple[Column, Column]) -> DataFrame:
    """The rows of located docs whose places aren't in dropped (two columns), with their columns, whatever their names."""
    names = dropped.columns
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")
    return docs.select(own, *(p.alias(n) for p, n in zip(places, names, strict=True))).join(small(dropped), names, "left_anti").select("own.*")


_STATE = "digest binary, doc_id long, file string, row long, n long"


class DigestState:
    """Keyed state over rows (digest, doc_id, file, row) in a folder that may grow: run() takes in what is new."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.rows, self.seen, self.checkpoint = spark, f"{folder}/rows", f"{folder}/seen", f"{folder}/state"

    def run(self, **options) -> DataFrame:
        """Take in all new files and return the state: one row a digest."""
        spark = self.spark
        before = {k: spark.conf.get(k, None) for k in ROCKS}
        for k, v in ROCKS.items():
            spark.conf.set(k, v)
        try:
            rows = spark.readStream.schema("digest binary, doc_id long, file string, row long").options(**options).parquet(self.rows)
            state = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "file", "row")).alias("first"), F.count("*").alias("n"))

            def keep(batch: DataFrame, number: int) -> None:
                batch.select("digest", "first.*", "n").write.mode("overwrite").parquet(f"{self.seen}/batch={number}")

            query = state.writeStream.outputMode("update").option("checkpointLocation", self.checkpoint).foreachBatch(keep).trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        try:
            seen = spark.read.schema(_STATE).parquet(self.seen)
        except AnalysisException:  # no row has ever come
            return spark.createDataFrame([], _STATE)
        last = F.max_by(F.struct("doc_id", "file", "row", "n"), "n")  # counts only grow: the last update of a digest
        return seen.select("digest", "doc_id", "file", "row", "n").groupBy("digest").agg(last.alias("last")).select("digest", "last.*")


def groups(docs: DataFrame, digest=sha256_of) -> tuple[DataFrame, DataFrame]:
    """docs with locators, and one row per row of docs: digest, doc_id, file, row, keep_id, keep_file, keep_row, n.
    digest: what rows are keyed by (tests pass a weak one)."""
    spark = docs.sparkSession
    ship(spark)
    docs = located(docs)
    folder = shared_folder(spark, "exact-dedup")
    file, row = path_and_row(docs)
    rows = docs.select(digest(normalised(F.col("text"))).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), file.alias("file"), row.alias("row"))
    rows.write.parquet(f"{folder}/rows")
    rows = spark.read.schema("digest binary, doc_id long, file string, row long").parquet(f"{folder}/rows")
    state = written(DigestState(spark, folder).run(), "digests")
    names = {"doc_id": "keep_id", "file": "keep_file", "row": "keep_row"}
    out = rows.join(state.withColumnsRenamed(names), "digest")
    # full bytes of all hits
    hits = small(state.where("n > 1").select(F.col("digest").alias("__digest")))
    text = normalised(F.col("text"))
    compared = docs.select(digest(text).alias("__digest"), text.alias("__text"), F.col("doc_id").cast("long").alias("doc_id"), file.alias("__file"), row.alias("__row")).join(hits, "__digest")
    unequal = compared.groupBy("__digest").agg(F.min("__text").alias("a"), F.max("__text").alias("b")).where("a <> b").select("__digest")
    unequal = written(unequal, "unequal")
    if not unequal.isEmpty():  # different texts under one digest: group those rows by their text
        own = written(compared.join(unequal, "__digest"), "unequal-rows")
        exact = own.groupBy("__digest", "__text").agg(F.min(F.struct("doc_id", F.col("__file").alias("file"), F.col("__row").alias("row"))).alias("first"), F.count("*").alias("n"))
        fixed = own.join(exact, ["__digest", "__text"]).select(F.col("__file").alias("file"), F.col("__row").alias("row"), F.col("first.doc_id").alias("f_id"), F.col("first.file").alias("f_file"), F.col("first.row").alias("f_row"), exact.n.alias("f_n"))
        out = out.join(fixed, ["file", "row"], "left")
        replaced = F.col("f_n").isNotNull()
        out = out.select("digest", "doc_id", "file", "row", *(F.when(replaced, F.col(f)).otherwise(F.col(k)).alias(k) for f, k in (("f_id", "keep_id"), ("f_file", "keep_file"), ("f_row", "keep_row"), ("f_n", "n"))))
    return docs, out


def _kept() -> Column:
    return (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))


def op5_exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs(doc_id, text)."""
    _, rows = groups(docs)
    return rows.select("doc_id", "keep_id", F.col("n").alias("group_size"), _kept().alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns, whatever their names."""
    docs, rows = groups(docs)
    dropped = written(rows.where(~_kept()).select("file", "row"), "dropped")
    return without(docs, dropped, path_and_row(docs))
