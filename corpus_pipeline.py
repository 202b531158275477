"""From raw documents to packed training sequences: filter, deduplicate, mask, pack.

STAGES lists (name, function) in order. A function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next function's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm.best_fit import op3_best_fit
from factloom.llm.common import table, written
from factloom.llm.jaccard_join import one_of_each
from factloom.llm.personal_data import redact
from factloom.llm.quality_gam import keep_good
from factloom.llm.queries import public
from factloom.llm.stream_dedup import distinct_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go (operator 8)."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest id stays (operator 5)."""
    return distinct_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard 0.8 or more connect the one with the smallest id stays (operator 6)."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked (operator 10)."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences of at most 2048 ids (operator 3)."""
    return op3_best_fit(docs, public("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("personal_data", personal_data), ("packing", packing)]

#: Tokens, links and trained models have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
