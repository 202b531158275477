"""Ranked lexical search with block-max pruning over a forward index (operator 11).

One pass over the texts makes a forward index of document ranges: a block holds, for documents that stand together in the
table, the terms that queries know and how often each document has them. When the corpus counts are known, occurrences
become impacts and every block gets the largest impact of each of its terms. The bound of a block for a query is the weighted
sum of these; no document in it can score more. A task takes its blocks in the order of their bounds, query by query, and
scores the documents of a block from their forward lists until the next bound is below the lowest score that still counts.
That threshold is the k-th score of what the task has seen, or the one that a first round gave, which scores only the best
block of each lot for each query: what all tasks then find is a lower bound for all.

Queries are a stated set: their terms are counted and at most TERMS of them go to the workers at once; more queries are
answered in further runs over the documents, by groups. Only the terms and results of queries pass the driver.

Cases: null or empty texts have no terms and never rank, nor count as documents; queries without terms have no results. Rows
of one item are one query with the terms of all of them, repeats included; a null item id is an id like others. Documents that
repeat rank each for itself, equal scores and ids in any order; null ids come last in ties. Empty tables give no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import blocks, id_and_text, record, ship, written
from factloom.llm.words import PATTERN, words

TOP = 20
#: Documents of a block.
BLOCK = 128
#: Rows (item, term) of the queries that are answered in one run.
TERMS = 2_000_000
#: Bytes of forward lists that a task holds.
LOT = 64 << 20
#: Fixed values of the score: scale, saturation, share of the length in a hundred.
SCALE, TERM, LENGTH, SHARE = 1_000_000_000, 1000, 12, 25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_list = lambda t: pa.list_(t)
_FORWARD = pa.schema([("documents", pa.int64()), ("words", pa.int64()), ("ids", _list(pa.int64())), ("sizes", _list(pa.int64())), ("ends", _list(pa.int32())), ("terms", _list(pa.int32())), ("counts", _list(pa.int32())), ("distinct", _list(pa.int32())), ("holders", _list(pa.int32()))])
_FORWARD_DDL = "documents long, words long, ids array<long>, sizes array<long>, ends array<int>, terms array<int>, counts array<int>, distinct array<int>, holders array<int>"
_BLOCK = pa.schema([("ids", _list(pa.int64())), ("ends", _list(pa.int32())), ("terms", _list(pa.int32())), ("impacts", _list(pa.int32())), ("distinct", _list(pa.int32())), ("maxima", _list(pa.int32()))])
_BLOCK_DDL = "ids array<long>, ends array<int>, terms array<int>, impacts array<int>, distinct array<int>, maxima array<int>"
_HIT = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])
_HIT_DDL = "item int, doc_id long, score long"


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, n) of items(item_id, text)."""
    found = F.explode(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(PATTERN), 0))
    return items.select("item_id", found.alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("n"))


def forward_index(docs: DataFrame, terms: dict[bytes, int], size: int = BLOCK) -> DataFrame:
    """Blocks of `size` documents of docs(doc_id, text) that hold some of `terms`, written. Each task also counts the documents
    with any terms, and all terms, that it read."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(terms)  # at most TERMS

    def index(batches) -> Iterator[pa.RecordBatch]:
        known = held.value
        documents = total = 0
        ids: list = []
        sizes: list[int] = []
        lists: list[list[tuple[int, int]]] = []

        def block() -> pa.RecordBatch:
            own = [t for found in lists for t, _ in found]
            distinct, holders = np.unique(np.array(own, np.int32), return_counts=True)
            counts = [n for found in lists for _, n in found]
            ends = np.cumsum([len(found) for found in lists]).tolist()
            return record(_FORWARD, [documents], [total], [ids], [sizes], [ends], [own], [counts], [distinct.tolist()], [holders.tolist()])

        for keys, texts in blocks(batches):
            for key, text in zip(keys, texts, strict=True):
                met = words(text)
                if not met:
                    continue
                documents, total = documents + 1, total + len(met)
                found = [(known[w], n) for w, n in Counter(met).items() if w in known]
                if found:
                    ids.append(key)
                    sizes.append(len(met))
                    lists.append(found)
                if len(ids) == size:
                    yield block()
                    documents, total, ids, sizes, lists = 0, 0, [], [], []
        if documents:
            yield block()

    return written(docs.mapInArrow(index, _FORWARD_DDL), "forward-index")


def with_impacts(index: DataFrame, documents: int, total: int) -> DataFrame:
    """The blocks with impacts for counts, and the largest impact of each term, written."""
    ship(index.sparkSession)

    def score(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n, ends = np.array(row["sizes"], np.int64), np.array(row["ends"], np.int64)
                terms, tf = np.array(row["terms"], np.int32), np.array(row["counts"], np.int64)
                m = np.repeat(100 - SHARE + SHARE * n * documents // total, np.diff(ends, prepend=0))
                impacts = SCALE * tf // (TERM * tf + LENGTH * m)
                distinct = np.array(row["distinct"], np.int32)
                maxima = np.zeros(len(distinct), np.int64)
                np.maximum.at(maxima, np.searchsorted(distinct, terms), impacts)
                yield record(_BLOCK, [row["ids"]], [row["ends"]], [row["terms"]], [impacts.tolist()], [row["distinct"]], [maxima.tolist()])

    some = index.where(F.size("ids") > 0).select("sizes", "ends", "terms", "counts", "distinct", "ids")
    return written(some.mapInArrow(score, _BLOCK_DDL), "impact-blocks")


@dataclass
class Queries:
    """Queries one after the other: the terms of query i, and their weights, are [starts[i], starts[i + 1])."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    vocabulary: int

    def bounds(self, distinct: np.ndarray, maxima: np.ndarray, room: np.ndarray) -> np.ndarray:
        """The most that any document of a block can score in each query. `room`: zeros, one for each term."""
        room[distinct] = maxima
        out = np.add.reduceat(self.weights * room[self.terms], self.starts[:-1]) if len(self.terms) else np.zeros(0, np.int64)
        room[distinct] = 0
        return out


class Best:
    """The best `top` (score, id) of one query; equal scores by ascending id, null last."""

    def __init__(self, top: int, floor: int):
        self.top, self.floor, self.scores, self.ids, self.nulls = top, floor, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= max(self.floor, 1)
        if not good.any():
            return
        scores, ids, nulls = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]]), np.concatenate([self.nulls, nulls[good]])
        first = np.lexsort((ids, nulls, -scores))[: self.top]
        self.scores, self.ids, self.nulls = scores[first], ids[first], nulls[first]
        if len(first) == self.top:
            self.floor = max(self.floor, int(self.scores[-1]))


def sweep(queries: Queries, floors: np.ndarray, top: int, first_only: bool):
    """What a task does with its blocks. first_only: scores only the best block of each lot for each query."""

    def lot(held: list[dict], best: list[Best], room: np.ndarray) -> None:
        bounds = np.stack([queries.bounds(b["distinct"], b["maxima"], room) for b in held], 1)
        for i, own in enumerate(best):
            order = np.argsort(-bounds[i], kind="stable")
            lo, hi = queries.starts[i], queries.starts[i + 1]
            room[queries.terms[lo:hi]] = queries.weights[lo:hi]
            for at in order[:1] if first_only else order:
                if bounds[i, at] < max(own.floor, 1):
                    break
                b = held[at]
                own.add(np.add.reduceat(room[b["terms"]] * b["impacts"], b["starts"]), b["ids"], b["nulls"])
            room[queries.terms[lo:hi]] = 0

    def run(batches) -> Iterator[pa.RecordBatch]:
        best = [Best(top, int(f)) for f in floors]
        room = np.zeros(queries.vocabulary, np.int64)
        held: list[dict] = []
        size = 0
        for batch in batches:
            for k in range(batch.num_rows):
                ids = batch.column("ids")[k].values
                row = {c: batch.column(c)[k].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "impacts", "distinct", "maxima")}
                ends = batch.column("ends")[k].values.to_numpy().astype(np.int64)
                row |= {"starts": np.concatenate([[0], ends[:-1]]), "ids": ids.fill_null(0).to_numpy(), "nulls": ids.is_null().to_numpy(zero_copy_only=False)}
                held.append(row)
                size += sum(v.nbytes for v in row.values())
                if size >= LOT:
                    lot(held, best, room)
                    held, size = [], 0
        if held:
            lot(held, best, room)
        for i, own in enumerate(best):
            if len(own.scores):
                yield record(_HIT, pa.array(np.full(len(own.scores), i, np.int32)), pa.array(own.ids, pa.int64(), mask=own.nulls), pa.array(own.scores))

    return run


def _first(hits: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def answer(docs: DataFrame, terms: DataFrame, top: int, size: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for the queries terms(item_id, term, n), at most TERMS rows."""
    spark = docs.sparkSession
    rows = terms.collect()
    items = sorted({r.item_id for r in rows}, key=lambda k: (k is None, k))
    place = {k: i for i, k in enumerate(items)}
    names = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
    index = forward_index(docs, {t.encode(): i for t, i in names.items()}, size)
    counted = index.agg(F.sum("documents"), F.sum("words")).first()
    documents, total = counted[0] or 0, counted[1] or 0
    holders = np.zeros(len(names), np.int64)
    for r in index.select(F.explode(F.arrays_zip("distinct", "holders")).alias("h")).groupBy("h.distinct").agg(F.sum("h.holders").alias("n")).collect():  # a row a term
        holders[r["distinct"]] = r["n"]
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) if d else 0 for d in holders.tolist()]
    by_item = sorted((place[r.item_id], names[r.term], r.n) for r in rows)
    of = np.array([i for i, _, _ in by_item], np.int64)
    queries = Queries(np.searchsorted(of, np.arange(len(items) + 1)), np.array([t for _, t, _ in by_item], np.int64), np.array([weight[t] * n for _, t, n in by_item], np.int64), len(names))
    kept = with_impacts(index, documents, total)
    seeds = _first(kept.mapInArrow(sweep(queries, np.zeros(len(items), np.int64), top, True), _HIT_DDL), top)
    floors = np.zeros(len(items), np.int64)
    for r in seeds.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") == top).collect():  # a row a query
        floors[r["item"]] = r["score"]
    found = _first(kept.mapInArrow(sweep(queries, floors, top, False), _HIT_DDL), top)
    named = spark.createDataFrame(list(enumerate(items)), f"item int, item_id {terms.schema['item_id'].dataType.simpleString()}")
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def op11_search(docs: DataFrame, items: DataFrame, top: int = TOP, size: int = BLOCK, terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of docs(doc_id, text) for each of items(item_id, text)."""
    rows = id_and_text(docs)
    asked = written(query_terms(items.select("item_id", F.col("text").cast("string").alias("text"))), "query-terms")
    groups = -(-asked.count() // terms)
    found = [answer(rows, asked if groups == 1 else asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g), top, size) for g in range(groups)]
    if not found:
        return asked.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where("false")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
