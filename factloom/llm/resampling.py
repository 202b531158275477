"""Importance resampling towards a target distribution, with word tries (operator 13).

Features are runs of one and two words, hashed to buckets by CRC-32. A task makes a trie of each lot of texts: below the root a
node for each word, below that a node for each word that follows it. Nodes hold how often their path was met and the CRC state
of its bytes, so a feature's bytes run through the CRC once and not once an occurrence: a word's by a byte a step for all words
of the trie, a second level's from its parent's state and its word's, as CRCs are linear. Levels are arrays by node, made
with numpy. A trie's counts are added up to bucket totals, and these over all tasks. Then documents walk the paths of other
tries whose nodes hold the gains of their buckets.

Ranks: rows (id, score) are dealt by range and numbered within their range; only the sizes of ranges meet in one place.

Cases: null or empty text has no words: weight 0, no rank. An empty table gives no rows; an empty target has all its totals 0.
A null id stands as an empty string in what the noise is drawn from and after others in ties. Rows that repeat are documents of
their own, each counted; equal ones get ranks in any order. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, id_and_text, record, ship, written
from factloom.llm.words import TABLE

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Characters of the texts of one trie, about.
CHARS = 4_000_000
#: Longer words go through the CRC one by one.
LONG = 64
_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
_STEP ^= _STEP[0]


def _advanced(crc: np.ndarray) -> np.ndarray:
    """CRC registers after a byte 0."""
    return _STEP[crc & np.uint32(255)] ^ (crc >> np.uint32(8))


def _shifts() -> np.ndarray:
    """[n, k, b]: what byte k of a register, of value b, is after n bytes 0. Registers are linear: their bytes' parts add up."""
    out = [np.array([[b << 8 * k for b in range(256)] for k in range(4)], np.uint32)]
    for _ in range(LONG):
        out.append(_advanced(out[-1]))
    return np.stack(out)


_SHIFTS = _shifts()


class WordTrie:
    """The paths of one and two words of some texts.

    nodes: of each word of the texts, its node of the first level; pairs: of each word that another one follows in its text
    (`inner`), the node of the second level; starts: where the texts' words begin. By level and node: crc, counts. Words of
    one length with one CRC share a node, as whatever is told from a node is the same for them."""

    def __init__(self, texts: list[str]):
        raw = [t.encode() for t in texts]
        joined = b" ".join([b"", *raw, b""]).translate(TABLE)
        letters = np.frombuffer(joined, np.uint8)
        word = letters != 32
        edges = np.flatnonzero(word[1:] != word[:-1]) + 1
        begin, lengths = edges[::2], edges[1::2] - edges[::2]
        begins = 1 + np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]).astype(np.int64)
        self.starts = np.searchsorted(begin, begins)
        crc = self._crc(joined, letters, begin, lengths)
        keys, at, self.nodes, n = np.unique((crc.astype(np.uint64) << np.uint64(32)) | lengths.astype(np.uint64), return_index=True, return_inverse=True, return_counts=True)
        first = (keys >> np.uint64(32)).astype(np.uint32)
        self.inner = np.ones(len(begin), bool)
        self.inner[self.starts[1:][self.starts[1:] > self.starts[:-1]] - 1] = False  # the last word of a text has none after it
        from_ = np.flatnonzero(self.inner)
        packed, self.pairs, m = np.unique((self.nodes[from_] << 32) | self.nodes[from_ + 1], return_inverse=True, return_counts=True)
        parent, child = packed >> 32, packed & 0xFFFFFFFF
        state = self._then(first, np.full(len(first), zlib.crc32(b" "), np.uint32), np.ones(len(first), np.int64))  # after the space
        size = lengths[at]
        second = self._then(state[parent], first[child], np.minimum(size[child], LONG))
        for k in np.flatnonzero(size[child] > LONG).tolist():
            where = at[child[k]]
            second[k] = zlib.crc32(joined[begin[where] : begin[where] + lengths[where]], int(state[parent[k]]))
        self.crc, self.counts = (first, second), (n, m)

    @staticmethod
    def _crc(joined: bytes, letters: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The CRC of each word, a byte a step for all that have one, the longest first."""
        short = np.minimum(lengths, LONG + 1).astype(np.uint8)
        order = np.argsort(LONG + 1 - short, kind="stable")
        place, left = begin[order], len(order) - np.cumsum(np.bincount(short, minlength=LONG + 2))
        crc = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for k in range(LONG):
            n = int(left[k])
            if not n:
                break
            crc[:n] = _STEP[(crc[:n] ^ letters[place[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
        out = np.empty(len(order), np.uint32)
        out[order] = crc ^ np.uint32(0xFFFFFFFF)
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[k] = zlib.crc32(joined[begin[k] : begin[k] + lengths[k]])
        return out

    @staticmethod
    def _then(before: np.ndarray, after: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The CRC of two strings one after the other, of theirs and the second's length (LONG at most)."""
        out = after.copy()
        for k in range(4):
            out ^= _SHIFTS[n, k, (before >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def words(self) -> np.ndarray:
        """How many words each text has."""
        return np.diff(self.starts)

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for crc, n in zip(self.crc, self.counts, strict=True):
            np.add.at(out, (crc % np.uint32(buckets)).astype(np.int64), n)
        return out

    def weights(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the number of features and the sum of the gains along its paths."""
        held = [gains[(crc % np.uint32(len(gains))).astype(np.int64)] for crc in self.crc]
        along = held[0][self.nodes]
        along[self.inner] += held[1][self.pairs]
        sums = np.concatenate([[0], np.cumsum(along)])
        return np.maximum(2 * self.words() - 1, 0), sums[self.starts[1:]] - sums[self.starts[:-1]]


def bucket_totals(texts: DataFrame, buckets: int = BUCKETS, chars: int = CHARS) -> np.ndarray:
    """How many features of texts(doc_id, text) fall into each bucket. The driver gets `buckets` numbers."""
    ship(texts.sparkSession)
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def count(batches) -> Iterator[pa.RecordBatch]:
        out = np.zeros(buckets, np.int64)
        for _, block in blocks(batches, chars):
            out += WordTrie(block).totals(buckets)
        some = np.flatnonzero(out)
        yield record(schema, pa.array(some.astype(np.int32)), pa.array(out[some]))

    found = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(buckets, np.int64)
    total[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier a bucket is in the target, smoothed by one for each bucket."""
    size, wanted, k = int(corpus.sum()), int(target.sum()), len(corpus)
    log = lambda s, t: math.floor(1000 * math.log(float(t + 1) * (size + k) / (float(s + 1) * (wanted + k))))
    return np.array([log(s, t) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: int | None, seed: int) -> int:
    """Gumbel noise in thousandths, of the key alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("row", pa.int64())])
_SCORED_DDL = "doc_id long, n_words long, n_features long, weight long, score long, row long"


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """docs(doc_id, text, row) with weight and score, written; `row` tells equal rows apart."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def score(batches) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for keys, texts in blocks(batches, CHARS):
            trie = WordTrie(texts)
            n, sums = trie.weights(gain)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            drawn = weight + np.array([noise(k["doc_id"], seed) for k in keys], np.int64)
            yield record(_SCORED, [k["doc_id"] for k in keys], pa.array(trie.words()), pa.array(n), pa.array(weight), pa.array(drawn), [k["row"] for k in keys])

    return written(docs.select(F.struct("doc_id", "row").alias("key"), "text").mapInArrow(score, _SCORED_DDL), "resampling-scores")


def numbered(rows: DataFrame) -> DataFrame:
    """rows(doc_id, score, row) with their place from 1, highest score first, then smallest id."""
    ship(rows.sparkSession)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    schema = pa.schema([("row", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def number(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 1
        for b in batches:
            yield record(schema, b.column(0), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows)))
            at += b.num_rows

    dealt = rows.select("row", "score", "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    places = written(dealt.select("row").mapInArrow(number, "row long, part int, nth long"), "resampling-places")
    sizes = {r.part: r.n for r in places.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row a partition
    before, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    starts = rows.sparkSession.createDataFrame(offsets, "part int, before long")
    return places.join(F.broadcast(starts), "part").select("row", (F.col("nth") + F.col("before")).alias("rank"))


def drawn(rows: DataFrame, target: DataFrame, percent: int, least_words: int, seed: int, buckets: int) -> DataFrame:
    """rows(doc_id, text, row) scored, with rank; it is null but for the `percent` of those with at least `least_words` words
    that are drawn."""
    gain = gains(bucket_totals(rows.select("doc_id", "text"), buckets), bucket_totals(target, buckets))
    every = scored(rows, gain, seed)
    able = every.where(F.col("n_words") >= least_words)
    ranks = numbered(able).where(F.col("rank") <= percent * able.count() // 100)
    return every.join(ranks, "row", "left")


def op13_resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document of docs(doc_id, text); target(item_id, text) holds the texts
    that the drawn ones should be like."""
    rows = id_and_text(docs).withColumn("row", F.monotonically_increasing_id())
    found = drawn(rows, id_and_text(target, "item_id"), percent, least_words, seed, buckets)
    return found.select("doc_id", "n_features", "weight", "score", F.col("rank").cast("long").alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs that are drawn, with all their columns."""
    own = written(docs.withColumn("__row", F.monotonically_increasing_id()), "resampling-documents")
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("__row").alias("row"))
    kept = drawn(rows, id_and_text(target, "item_id"), percent, least_words, seed, buckets).where("rank is not null").select(F.col("row").alias("__row"))
    return own.join(kept, "__row", "left_semi").drop("__row")
