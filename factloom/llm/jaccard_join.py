"""Exact Jaccard join over word shingles in the metric space of sets (operator 6).

Words are [^\\x20\\x09-\\x0D]+ after A-Z became a-z; a document's set holds the 64-bit hashes of its distinct 5-word
shingles. The distance of two sets is 1 - Jaccard, which is a metric; documents link at 0.2 or less.

1. Documents with equal sets are one class (a 128-bit key); everything below works on classes.
2. A class links only where at least 80 % of its shingles are in another class. Two sieves throw out classes that have
   too few shared shingles: the first over the ceil(0.1 n) + n - ceil(0.8 n) shingles that come first in hash order (of
   which any partner must have a known number), the second over whole sets. Both count the classes that hold a shingle
   and know nothing of pairs. A block of documents counts its own shingles first and sends each of them once, so what a
   very common shingle brings together is a number for each block, not its documents.
3. Regions: shingles, ordered from rare to common, serve as the first pivots. As a link leaves at most n - ceil(0.8 n)
   shingles unmatched, linked classes meet in the region of one of their n - ceil(0.8 n) + 1 first shingles.
4. A region joins by a pivot, its most central class: comparing it with the others puts those within the radius into one
   Voronoi cell, and cells that share a class are one component. Regions that lie in one component are done.
5. The cells that share one of the other regions are joined exactly. By the triangle inequality, seen from fixed pivots
   the two ends of a link lie in a narrow window: boundary classes are replicated into the next shell, pairs outside the
   windows are left out, and what remains is compared in full. Nothing is capped.

Classes already in one component need no comparison, so a large group of near copies takes one comparison with its
pivot each, not all pairs. Comparisons with one pivot are spread over tasks by a salt, large shells by blocks.

Cases: null, empty and blank texts have no shingles and link with nothing; fewer than five words make one shingle; rows
with equal texts or ids each get their row; rows without id link like others, and a component is named by its smallest id
that isn't null (null if all are); an empty table gives no rows; other columns are not read. Rows are told apart by file
and place, never by id; frames that aren't read from files are written first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, record, ship, small, written
from factloom.llm.stream_dedup import located, locator, without
from factloom.llm.token_shards import mix

SHINGLE = 5
#: Shingles are sums of word hashes with one odd factor a place.
_PLACE = np.array([0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F], np.uint64)


class WordHashes(dict):
    """word -> 64 bits of its BLAKE2b digest. At most `limit` short words are remembered."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value


_words = WordHashes()


def shingles(text: str) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: exactly A-Z, and exactly \\x20 and \\x09-\\x0D
    if not words:
        return np.zeros(0, np.uint64)
    word = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(word))
    m = len(word) - k + 1
    with np.errstate(over="ignore"):
        total = np.full(m, k, np.uint64)
        for i in range(k):
            total += word[i : i + m] * _PLACE[i]
        return np.unique(mix(total))


def needed(n):
    """How many of n shingles any partner must share."""
    return -(-4 * n // 5)


def key_of(own: np.ndarray) -> bytes | None:
    return blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)


def grouped(batches, width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, rows) of batches sorted by their first `width` columns."""
    rows: list[tuple] = []
    at = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:width] != at:
                if rows:
                    yield at, rows
                rows, at = [], row[:width]
            rows.append(row[width:])
    if rows:
        yield at, rows


# --- the first sieve -------------------------------------------------------------------------------------------------
#: What a block of documents sends to a bucket of hashes: entries (hash, place in the block's classes), those classes, and
#: how many shared shingles the block itself found for them.
_PACK = pa.schema([("bucket", pa.int32()), ("hashes", pa.binary()), ("places", pa.binary()), ("keys", pa.binary()), ("needs", pa.binary()), ("local", pa.binary())])
_PACK_DDL = "bucket int, hashes binary, places binary, keys binary, needs binary, local binary"
#: The place of a hash that several classes of a block hold: they know that it is shared, others have to be told.
SHARED = np.uint32(0xFFFFFFFF)


def packed(sets: list[np.ndarray], keys: list[bytes], needs: list[int], buckets: int, spread: int) -> Iterator[pa.RecordBatch]:
    if not sets:
        return
    place = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    hashes, first, number, times = np.unique(np.concatenate(sets), return_index=True, return_inverse=True, return_counts=True)
    local = np.bincount(place[times[number] > 1], minlength=len(sets)).astype(np.uint32)
    entry = np.where(times > 1, SHARED, place[first])
    bucket = bucket_of(hashes, buckets)
    order = np.argsort(bucket, kind="stable")
    hashes, entry = hashes[order], entry[order]
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    all_keys, all_needs = np.frombuffer(b"".join(keys), "V16"), np.array(needs, np.uint32)
    rows: list[list] = [[] for _ in _PACK]
    for b in range(buckets):
        own = entry[cuts[b] : cuts[b + 1]]
        some = np.unique(own[own != SHARED])
        places = np.where(own == SHARED, SHARED, np.searchsorted(some, own).astype(np.uint32))
        counts = np.zeros(len(some), np.uint32)
        if b == spread % buckets:
            extra = np.setdiff1d(np.flatnonzero(local).astype(np.uint32), some, assume_unique=True)
            some = np.concatenate([some, extra])
            counts = local[some]
        if len(own) or len(some):
            for column, value in zip(rows, (b, hashes[cuts[b] : cuts[b + 1]].tobytes(), places.tobytes(), all_keys[some].tobytes(), all_needs[some].tobytes(), counts.tobytes()), strict=True):
                column.append(value)
    yield record(_PACK, *rows)


def shared_in(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a bucket: keys, needs, and how many shared shingles each class has there."""
    keys = np.frombuffer(b"".join(r[2] for r in rows), "V16")
    needs = np.frombuffer(b"".join(r[3] for r in rows), np.uint32)
    local = np.frombuffer(b"".join(r[4] for r in rows), np.uint32)
    distinct, first, number = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(number, local, len(distinct)).astype(np.int64)
    of, at = [], 0
    for r in rows:
        p = np.frombuffer(r[1], np.uint32).astype(np.int64)
        shared = p == int(SHARED)
        p[shared] = 0
        of.append(np.where(shared, -1, number[p + at] if len(number) else -1))
        at += len(r[3]) // 4
    hashes, of = np.frombuffer(b"".join(r[0] for r in rows), np.uint64), np.concatenate(of)
    order = np.lexsort((of, hashes))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    hashes, of = hashes[new], of[new]
    begin = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([begin, [len(hashes)]]))
    known = np.repeat((size > 1) | (of[begin] < 0), size) if len(hashes) else np.zeros(0, bool)
    total += np.bincount(of[known & (of >= 0)], minlength=len(distinct))
    return distinct, needs[first], total


def distinct_sets(texts: list[str]) -> dict[bytes, np.ndarray]:
    own: dict[bytes, np.ndarray] = {}
    for t in texts:
        s = shingles(t)
        if len(s):
            own.setdefault(key_of(s), s)
    return own


def classes_of(rows: DataFrame) -> DataFrame:
    """place, n_shingles, key (null without shingles) of rows(place, text)."""
    schema = pa.schema([("f", pa.int64()), ("r", pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for places, texts in blocks(batches):
            sets = [shingles(t) for t in texts]
            yield record(schema, *([p[k] for p in places] for k in ("f", "r", "doc_id")), [len(s) for s in sets], [key_of(s) for s in sets])

    return rows.select(F.struct("f", "r", "doc_id").alias("place"), "text").mapInArrow(run, "f long, r long, doc_id long, n_shingles long, key binary")


def first_sieve(rows: DataFrame, buckets: int) -> DataFrame:
    """Keys of the classes that share enough of their first shingles with others (or with rows of the same class, which
    costs the second sieve some work)."""

    def emit(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spread = TaskContext.get().partitionId()
        for _, texts in blocks(batches):
            own = distinct_sets(texts)
            n = [len(s) for s in own.values()]
            heads = [s[: k - needed(k) + -(-k // 10)] for s, k in zip(own.values(), n, strict=True)]
            yield from packed(heads, list(own), [-(-needed(k) // 10) for k in n], buckets, spread)
            spread += 1

    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("needs", pa.binary()), ("n", pa.binary())])

    def count(batches) -> Iterator[pa.RecordBatch]:
        """What each bucket found, packed by parts of the classes, as it was packed by buckets of the hashes."""
        for _, group in grouped(batches, 1):
            keys, needs, n = shared_in(group)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            keys, needs, n = keys[some], needs[some], n[some].astype(np.uint32)
            part = np.frombuffer(keys.tobytes(), "<u4")[::4] % np.uint32(buckets)
            order = np.argsort(part, kind="stable")
            keys, needs, n = keys[order], needs[order], n[order]
            parts, cuts = np.unique(part[order], return_index=True)
            ends = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True))
            yield record(schema, parts.astype(np.int32), *([x[a:b].tobytes() for a, b in ends] for x in (keys, needs, n)))

    def total(batches) -> Iterator[pa.RecordBatch]:
        for _, group in grouped(batches, 1):
            keys, number = np.unique(np.frombuffer(b"".join(r[0] for r in group), "V16"), return_inverse=True)
            n = np.bincount(number, np.frombuffer(b"".join(r[2] for r in group), np.uint32), len(keys))
            need = np.zeros(len(keys), np.uint32)
            np.maximum.at(need, number, np.frombuffer(b"".join(r[1] for r in group), np.uint32))
            yield record(pa.schema([("key", pa.binary())]), [keys[i].tobytes() for i in np.flatnonzero(n >= need)])

    dealt = rows.select(F.lit(None).cast("long").alias("no_id"), "text").mapInArrow(emit, _PACK_DDL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    counts = dealt.mapInArrow(count, "part int, keys binary, needs binary, n binary")
    return counts.repartition(buckets, "part").sortWithinPartitions("part").mapInArrow(total, "key binary")


# --- the second sieve ------------------------------------------------------------------------------------------------
def sets_of(rows: DataFrame) -> DataFrame:
    """key, n and the sorted hashes of each row's text."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("hashes", pa.binary())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for _, texts in blocks(batches):
            own = distinct_sets(texts)
            yield record(schema, list(own), [len(s) for s in own.values()], [s.tobytes() for s in own.values()])

    return rows.select(F.lit(None).cast("long").alias("no_id"), "text").mapInArrow(run, "key binary, n long, hashes binary")


#: Bytes of hashes in a block, about; entries that a bucket has, about; and entries in a row, about: rows of many megabytes
#: are costly to move.
BLOCK_BYTES, BUCKET_ENTRIES, ROW_ENTRIES = 8_000_000, 1_500_000, 40_000


def second_sieve(sets: DataFrame, total: int) -> DataFrame:
    """Classes that share enough of their whole sets: key, n, central (mean number of classes that hold a shingle) and the
    regions they are in. total: entries of all sets."""
    buckets = max(1, math.ceil(total / BUCKET_ENTRIES))
    block_ddl = "block long, bucket int, nth int, keys binary, numbers binary, hashes binary"
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("nth", pa.int32()), ("keys", pa.binary()), ("numbers", pa.binary()), ("hashes", pa.binary())])

    def emit(batches) -> Iterator[pa.RecordBatch]:
        """A block's own rows (bucket -1), and what it asks each bucket: hashes with their numbers of classes."""
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32

        def rows(keys: list[bytes], sizes: list[int], raws: list[bytes]) -> pa.RecordBatch:
            own = np.cumsum(sizes) // ROW_ENTRIES
            cuts = np.flatnonzero(np.diff(own, prepend=-1)).tolist()
            pieces = list(zip(cuts, [*cuts[1:], len(keys)], strict=True))
            out = [[block] * len(pieces), [-1] * len(pieces), list(range(len(pieces)))]
            out += [[b"".join(keys[a:b]) for a, b in pieces], [np.array(sizes[a:b], np.uint32).tobytes() for a, b in pieces], [b"".join(raws[a:b]) for a, b in pieces]]
            hashes, times = np.unique(np.frombuffer(b"".join(raws), np.uint64), return_counts=True)
            bucket = bucket_of(hashes, buckets)
            order = np.argsort(bucket, kind="stable")
            hashes, times = hashes[order], times[order].astype(np.uint32)
            asked, cuts = np.unique(bucket[order], return_index=True)
            for b, lo, hi in zip(asked.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(hashes)], strict=True):
                for nth, at in enumerate(range(lo, hi, ROW_ENTRIES)):
                    end = min(hi, at + ROW_ENTRIES)
                    for column, value in zip(out, (block, b, nth, None, times[at:end].tobytes(), hashes[at:end].tobytes()), strict=True):
                        column.append(value)
            return record(schema, *out)

        keys, sizes, raws, held = [], [], [], 0
        for b in batches:
            for key, n, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys.append(key)
                sizes.append(n)
                raws.append(raw)
                held += len(raw)
                if held >= BLOCK_BYTES:
                    yield rows(keys, sizes, raws)
                    keys, sizes, raws, held, block = [], [], [], 0, block + 1
        if keys:
            yield rows(keys, sizes, raws)

    back = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("nth", pa.int32()), ("df", pa.binary())])

    def answer(batches) -> Iterator[pa.RecordBatch]:
        for (bucket,), group in grouped(batches, 1):
            sizes = [len(r[2]) // 4 for r in group]
            _, number = np.unique(np.frombuffer(b"".join(r[3] for r in group), np.uint64), return_inverse=True)
            df = np.bincount(number, np.frombuffer(b"".join(r[2] for r in group), np.uint32))[number]
            df = np.minimum(df, 0xFFFFFFFF).astype(np.uint32)
            ends = np.cumsum([0, *sizes])
            yield record(back, [r[0] for r in group], [bucket] * len(group), [r[1] for r in group], [df[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)])

    out = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("central", pa.float64()), ("regions", pa.list_(pa.int64()))])

    def choose(batches) -> Iterator[pa.RecordBatch]:
        for _, group in grouped(batches, 1):
            own = [r for r in group if r[0] < 0]
            keys, n = np.frombuffer(b"".join(r[2] for r in own), "V16"), np.frombuffer(b"".join(r[3] for r in own), np.uint32).astype(np.int64)
            hashes, number = np.unique(h := np.frombuffer(b"".join(r[4] for r in own), np.uint64), return_inverse=True)
            df = np.empty(len(hashes), np.uint32)
            df[np.argsort(bucket_of(hashes, buckets), kind="stable")] = np.frombuffer(b"".join(r[5] for r in group[len(own) :]), np.uint32)
            df = df[number]
            place = np.repeat(np.arange(len(n)), n)
            enough = np.bincount(place, df > 1, len(n)) >= needed(n)
            central = np.bincount(place, df, len(n)) / n
            order = np.lexsort((h, df, place))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
            head = order[(rank <= np.repeat(n - needed(n), n)) & (df[order] > 1) & enough[place]]
            some = np.flatnonzero(enough)
            counts = np.bincount(place[head], minlength=len(n))[some]
            regions = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(h[head].view(np.int64)))
            yield record(out, [keys[i].tobytes() for i in some], n[some], central[some], regions)

    ship(sets.sparkSession)
    asked = written(sets.select("key", "n", "hashes").mapInArrow(emit, block_ddl), "blocks")
    questions = asked.where("bucket >= 0").select("bucket", "block", "nth", "numbers", "hashes")
    answers = questions.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "block long, bucket int, nth int, df binary")
    none = F.lit(None).cast("binary")
    together = asked.where("bucket < 0").withColumn("df", none).unionByName(answers.withColumns({"keys": none, "numbers": none, "hashes": none}))
    dealt = together.repartition("block").sortWithinPartitions("block", "bucket", "nth")
    return dealt.mapInArrow(choose, "key binary, n long, central double, regions array<long>")


# --- comparing and joining -------------------------------------------------------------------------------------------
#: Comparisons with one pivot that a task gets at most, about.
SALT_ROWS = 4096


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with both sizes and the size of the intersection. One b may have any number of a."""
    spark = pairs.sparkSession
    salts = F.ceil(F.col("m") / SALT_ROWS).cast("int")
    many = written(pairs.groupBy("b").agg(F.count("*").alias("m")).select("b", salts.alias("salts")), "pivot-sizes")
    left = pairs.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int")).select("a", "b", "salt")
    # pairs go to the sets where they are few, so only sets that are compared move
    left = sets.withColumnsRenamed({"key": "a"}).join(small(written(left, "salted-pairs")), "a").select("b", "salt", "a", "n", "hashes")
    right = sets.withColumnsRenamed({"key": "b"}).join(small(many), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("binary").alias("a"), "n", "hashes")
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("na", pa.int64()), ("nb", pa.int64()), ("common", pa.int64())])
    ship(spark)

    def run(batches) -> Iterator[pa.RecordBatch]:
        pivot, size = None, 0
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for b, _, a, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if a is None:
                    pivot, size = own, n
                    continue
                at = np.searchsorted(pivot, own)
                common = int((pivot[np.minimum(at, size - 1)] == own).sum())
                for column, value in zip(rows, (a, b, n, size, common), strict=True):
                    column.append(value)
            yield record(schema, *rows)

    together = left.unionByName(right).repartition("b", "salt").sortWithinPartitions("b", "salt", "a")
    return together.mapInArrow(run, "a binary, b binary, na long, nb long, common long")


def linked() -> F.Column:
    return 100 * F.col("common") >= 80 * (F.col("na") + F.col("nb") - F.col("common"))


def components(edges: DataFrame) -> DataFrame:
    """edges(u, v) of any orderable type -> (u, root), the smallest member of u's component. Labels fall to the smallest
    neighbour's and then jump to their label's label, so long chains take a number of rounds in the order of their log."""
    both = written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")), "labels")
    while True:
        of_v = label.select(F.col("u").alias("v"), F.col("root").alias("other"))
        lowest = both.join(of_v, "v").groupBy("u").agg(F.min("other").alias("other"))
        step = label.join(lowest, "u").select("u", F.least("root", "other").alias("root"), F.col("root").alias("was"))
        jump = label.select(F.col("u").alias("root"), F.col("root").alias("beyond"))
        step = step.join(jump, "root", "left").select("u", F.least("root", F.coalesce("beyond", "root")).alias("root"), "was")
        step = written(step.withColumn("moved", F.col("root") != F.col("was")), "labels")
        label = step.select("u", "root")
        if step.where("moved").isEmpty():
            return label


def relabelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(key, label) after links(a, b)."""
    ends = links.join(nodes.withColumnsRenamed({"key": "a", "label": "u"}), "a").join(nodes.withColumnsRenamed({"key": "b", "label": "v"}), "b")
    edges = written(ends.where("u <> v").select("u", "v").distinct(), "links")
    if edges.isEmpty():
        return nodes
    roots = components(edges).withColumnsRenamed({"u": "label"})
    return written(nodes.join(roots, "label", "left").select("key", F.coalesce("root", "label").alias("label")), "nodes")


#: Parts of the hash space that serve as fixed pivots, coarse and fine; classes of a shell that a task compares with others.
COARSE, FINE, BLOCK = 64, 256, 1024


def cells(chosen: DataFrame, nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compare the members of each region of chosen(key, central, regions) with its most central one. Returns nodes with
    the components so far as labels, and (rid, key, label) of the regions that more than one component shares."""
    members = chosen.select(F.explode("regions").alias("rid"), "key", "central")
    # what is gathered for each region is written before it is joined back, so a join with a large region can be split
    pivots = members.groupBy("rid").agg(F.max(F.struct("central", "key")).alias("top"), F.count("*").alias("m")).where("m > 1")
    pivots = written(pivots.select("rid", F.col("top.key").alias("pivot")), "pivots")
    pairs = members.join(small(pivots), "rid").where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct()
    nodes = relabelled(nodes, compared(written(pairs, "pairs"), sets).where(linked()).select("a", "b"))
    # labels meet whole rows, one a class, and only then are regions dealt out: a long document has many
    labelled = written(chosen.select("key", "regions").join(nodes, "key"), "labelled").select(F.explode("regions").alias("rid"), "key", "label")
    mixed = labelled.groupBy("rid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("rid")
    return nodes, written(labelled.join(small(written(mixed, "mixed-regions")), "rid"), "mixed")


def candidates(mixed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of a region of mixed(rid, key, label), in different components, that may link: all that do,
    and few others.

    The windows are those of the symmetric difference, a metric in which a link of sets A and B means
    |A ^ B| <= (|A| + |B|) / 9: seen from the empty set, sizes differ by a factor of 1.25 at most, so each class is in the
    shell of its size and, as a replica, in the next; seen from FINE fixed parts of the hash space, the numbers of shingles
    in the parts differ by no more than |A ^ B| in all. Shells of more than BLOCK classes are dealt to tasks as pairs of
    blocks. A pair that shares several regions is found in each; one is kept."""
    counts = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("counts", pa.binary())])

    def count(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.bincount(((np.frombuffer(raw, np.uint64) >> np.uint64(33)) % np.uint64(FINE)).astype(np.int64), minlength=FINE) for raw in b.column(2).to_pylist()]
            yield record(counts, *b.columns[:2], [np.minimum(r, 255).astype(np.uint8).tobytes() for r in rows])

    held = written(mixed.select("key").distinct(), "cell-members")
    signed = written(sets.join(small(held), "key", "left_semi").select("key", "n", "hashes").mapInArrow(count, "key binary, n long, counts binary"), "signatures")
    # powers of 1.25, a little less so that rounding can't put a partner two shells away
    shell = F.floor(F.log(F.col("n").cast("double")) / math.log(1.2500001)).cast("int")
    sized = signed.select("key", "n", shell.alias("own"))
    placed = mixed.join(sized, "key").select("rid", "key", F.col("label.key").alias("cell"), "n", "own", F.explode(F.array("own", F.col("own") + 1)).alias("shell"))
    placed = written(placed, "shells")
    spread = placed.groupBy("rid", "shell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.min("cell").alias("low"), F.max("cell").alias("high"), F.max(F.col("own") == F.col("shell")).alias("home"))
    spread = written(spread.where("low <> high and home").select("rid", "shell", "blocks"), "shell-sizes")
    dealt = placed.join(small(spread), ["rid", "shell"]).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).join(signed.select("key", "counts"), "key")
    dealt = dealt.select(
        "rid", "shell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"), (F.col("own") == F.col("shell")).alias("home"), "key", "cell", "n", "counts"
    )
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def join(batches) -> Iterator[pa.RecordBatch]:
        for (_, _, low, high), rows in grouped(batches, 4):
            second, home, keys, cell, n, raw = (list(c) for c in zip(*rows, strict=True))
            second, home, n = np.array(second), np.array(home), np.array(n, np.int64)
            cell = np.unique(np.frombuffer(b"".join(cell), "V16"), return_inverse=True)[1]
            fine = np.frombuffer(b"".join(raw), np.uint8).reshape(len(n), FINE).astype(np.int16)
            coarse = fine.reshape(len(n), COARSE, -1).sum(2, dtype=np.int16)
            out: tuple[list, list] = ([], [])
            for x in range(len(n)):
                ok = (cell != cell[x]) & (home | home[x]) & (10 * n <= 12.6 * n[x]) & (10 * n[x] <= 12.6 * n)
                ok &= np.arange(len(n)) > x if low == high else second & ~second[x]
                ys = np.flatnonzero(ok)
                for grain in (coarse, fine):
                    ys = ys[9 * np.abs(grain[ys] - grain[x]).sum(1, dtype=np.int64) <= n[ys] + n[x]] if len(ys) else ys
                out[0].extend(max(keys[x], keys[y]) for y in ys)
                out[1].extend(min(keys[x], keys[y]) for y in ys)
            yield record(schema, *out)

    task = ["rid", "shell", "low", "high"]
    return dealt.repartition(*task).sortWithinPartitions(*task).mapInArrow(join, "a binary, b binary").distinct()


def join_regions(chosen: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Join all regions of chosen(key, central, regions); returns nodes(key, label) with their components as labels."""
    nodes, mixed = cells(chosen, nodes, sets)
    if mixed.isEmpty():
        return nodes
    pairs = written(candidates(mixed, sets), "pairs")
    return relabelled(nodes, compared(pairs, sets).where(linked()).select("a", "b"))


def joined(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of docs(doc_id, text), read from files: f, r (file and place), doc_id, n_shingles, key of every row; and key, label of
    the classes that link, where equal labels are one component. A label starts with whether and which smallest id there is."""
    spark = docs.sparkSession
    ship(spark)
    file, row = locator(docs)
    rows = docs.select(file.alias("f"), row.alias("r"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, rows.rdd.getNumPartitions())
    own = written(classes_of(rows), "classes")
    classes = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("f", "r")).alias("at"))
    first = written(first_sieve(rows, parts).join(classes, "key"), "first-sieve")
    sets = written(sets_of(rows.join(small(first.select("at.f", "at.r")), ["f", "r"], "left_semi")), "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    chosen = written(second_sieve(sets, total), "second-sieve")
    label = F.struct(F.col("rep").isNull().alias("no_id"), F.coalesce("rep", F.lit(0)).alias("doc"), "key").alias("label")
    nodes = written(chosen.select("key").join(first, "key").select("key", label), "nodes")
    return own, join_regions(chosen, nodes, sets)


def op6_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text)."""
    own, nodes = joined(located(docs))
    classes = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    roots = nodes.select("key", F.when(~F.col("label.no_id"), F.col("label.doc")).alias("root"))
    of_class = classes.join(roots, "key", "left").select("key", F.coalesce("root", "rep").alias("class_id"))
    return own.join(of_class, "key", "left").select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay when of each component only the document with the smallest id stays; with their columns.

    Cases: rows without id come before others, of rows with equal ids the first by file and place stays; null, empty and
    blank texts link with nothing and stay; an empty table stays empty; other columns may have any names."""
    docs = located(docs)
    own, nodes = joined(docs)
    labels = nodes.select("key", F.col("label.key").alias("group"))
    linked_ = own.where("key is not null").join(labels, "key", "left").select(F.coalesce("group", "key").alias("group"), F.struct("doc_id", "f", "r").alias("place"))
    linked_ = written(linked_, "components")
    first = linked_.groupBy("group").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    dropped = written(linked_.join(small(written(first, "first")), "group").where("place <> first").select("place.f", "place.r"), "near-copies")
    return without(docs, dropped, locator(docs))
