"""What the operators of this subpackage share: shared folders, inputs and Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import session
from factloom.session import shared_folder, written  # noqa: F401

#: Settings for rows that hold whole texts, where a session has Spark's own: bytes in an Arrow batch between Spark and Python,
#: and rows that a Parquet reader decodes at once.
LEAN = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304"), "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512")}


def ship(spark: SparkSession) -> None:
    """What every operator that runs Python needs: workers that find this package, and bounded batches."""
    session.ship(spark)
    for name, (default, own) in LEAN.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, own)


_HELD: dict = {}


def release() -> None:
    """Give back what a worker, which Spark uses again and again, holds from before: machines, and memory that is free but
    that allocators keep."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def machine(kind: type, *args):
    """kind(*args), made once per worker. A worker keeps the machine of one operator at a time: machines remember much."""
    key = kind, args
    if key not in _HELD:
        release()
        _HELD[key] = kind(*args)
    return _HELD[key]


#: A set of keys is broadcast if its rows, counted, are at most so many bytes; beyond that Spark joins by shuffles.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 200


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is small enough."""
    return F.broadcast(df) if df.count() * ROW_BYTES <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that text operators read, under fixed names, whatever other columns there are."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))


def blocks(batches: Iterable[pa.RecordBatch], chars: int = 4_000_000, keep: bool = False) -> Iterator[tuple[list, list[str]]]:
    """Rows (doc_id, text) of Arrow batches regrouped to lists of at least `chars` characters (the last may be shorter); null text is ''.
    keep: the caller uses a machine, which stays."""
    if not keep:
        release()
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1])
            if size >= chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
    ids, texts = [], []
    if not keep:
        release()


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
