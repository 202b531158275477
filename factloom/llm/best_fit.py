"""Best-fit packing of token sequences by bulk-synchronous supersteps (operator 3).

Documents are tokenised and cut into pieces of at most `capacity` ids. Pieces and gaps (the room left in a sequence) are
kept range-sorted as size classes: of either there are at most `capacity`, whatever the input, so what a superstep
exchanges is bounded. A superstep takes all pieces of the largest length that is left and sweeps over the gap classes
from that length upwards: each class of gaps, the successor first, takes as many pieces as its gaps have room for.
Conflicts are resolved by rank: pieces fill the gaps on offer in the order of their ranks. Then the gaps that were used
move to their new class, and the next superstep follows; pieces without a gap open new sequences, as many to each as fit. This is the
result that best-fit decreasing gives when it places one piece after another.

The executors count pieces for each length and partition, and rank the pieces of a length by prefix sums over partitions
(one window over counts, no window over pieces). The plan is a list of rank intervals (length, first rank, first
sequence, offset): a sequence class is split at most once a superstep, so the list depends on the capacity and not on the
number of documents. It is broadcast, and every piece finds its place by binary search.

Cases: null text is empty (its only id is the end id); equal documents are packed each on its own; an empty table gives
an empty result; other columns are not read. Sequence numbers depend on how the input is split over tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import blocks, id_and_text, machine, record, ship, written
from factloom.llm.memo_encode import MemoEncoder

#: Bytes of word pieces that a worker remembers (an executor may keep several workers), and characters that it encodes at once.
PIECES, CHARS = 112 << 20, 1_500_000
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
_PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece; nth: how many pieces of that length the task made before it."""
    ship(docs.sparkSession)

    def cut(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = machine(MemoEncoder, tokenizer, PIECES), TaskContext.get().partitionId()
        end, made = end_id.to_bytes(4, "little"), [0] * (capacity + 1)
        for ids, texts in blocks(batches, CHARS, keep=True):
            rows: list[list] = [[] for _ in _PIECE]
            for doc, raw in zip(ids, enc.ids(texts), strict=True):
                raw += end
                for i, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at : at + 4 * capacity]
                    n = len(own) // 4
                    for column, value in zip(rows, (doc, i, at // 4, n, zlib.crc32(own), part, made[n]), strict=True):
                        column.append(value)
                    made[n] += 1
            yield record(_PIECE, *rows)

    return docs.mapInArrow(cut, _PIECE_DDL)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Supersteps over the size classes. Returns rank intervals (length, first rank, first sequence, offset), sorted, and
    the number of sequences."""
    rooms: list[int] = []  # the gap classes that aren't empty, sorted
    gaps: dict[int, deque] = {}  # room -> runs (first sequence, number of sequences)
    out, sequences = [], 0

    def offer(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in gaps:
                gaps[room] = deque()
                insort(rooms, room)
            gaps[room].append((first, n))

    def fill(first: int, n: int, room: int) -> int:
        """Put pieces into sequences first .. first + n - 1, each of that room, one sequence after another; returns how many
        sequences were touched."""
        nonlocal rank, left
        each = room // length
        full, rest = min(n, left // each), 0
        for i in range(each if full else 0):
            out.append((length, rank, first, capacity - room + i * length))
            rank += full
        offer(room - each * length, first, full)
        left -= full * each
        if full < n and left:
            rest = left
            for i in range(rest):
                out.append((length, rank + i, first + full, capacity - room + i * length))
            rank, left = rank + rest, 0
            offer(room - rest * length, first + full, 1)
        return full + (rest > 0)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms.pop(at)
            runs = gaps.pop(room)
            while left and runs:
                first, n = runs.popleft()
                used = fill(first, n, room)
                if used < n:
                    runs.appendleft((first + used, n - used))
            for first, n in runs:
                offer(room, first, n)
        if left:
            sequences += fill(sequences, left, capacity)
    return np.array(sorted(out), np.int64).reshape(-1, 4), sequences


def plan_in_jobs(counts: DataFrame, capacity: int, most: int | None = None) -> DataFrame:
    """The same plan with every superstep as Spark jobs: gaps stand range-sorted in a table, a window sums up their slots from
    the successor of the length upwards, pieces fill them by rank, and the table of gaps is written anew. Returns the rank
    intervals (length, rank, sequence, offset). counts(length, n); most: supersteps to run (all if None).

    A superstep takes a length, so there are as many as there are lengths, up to `capacity`; README has the time that they
    take, which is why op3_best_fit() runs plan()."""
    spark = counts.sparkSession
    ddl = "room long, first long, n long"
    gaps, intervals, sequences = spark.createDataFrame([], ddl), None, 0
    upwards = Window.orderBy("room", "nth").rowsBetween(Window.unboundedPreceding, -1)
    gaps = gaps.withColumn("nth", F.lit(0).cast("long"))
    for step, (length, pieces_) in enumerate(sorted(((r.length, r.n) for r in counts.collect()), reverse=True)[:most]):  # capacity rows at most
        each = F.floor(F.col("room") / length)
        fit = gaps.where(F.col("room") >= length).withColumn("each", each).withColumn("before", F.coalesce(F.sum(each * F.col("n")).over(upwards), F.lit(0)))
        left = pieces_ - (gaps.where(F.col("room") >= length).agg(F.sum(each * F.col("n"))).first()[0] or 0)
        if left > 0:
            new = -(-left // (capacity // length))
            fresh = spark.createDataFrame([(capacity, sequences, new, 0, capacity // length, pieces_ - left)], "room long, first long, n long, nth long, each long, before long")
            fit, sequences = fit.unionByName(fresh), sequences + new
        used = fit.where(F.col("before") < pieces_).withColumn("take", F.least(F.col("each") * F.col("n"), F.lit(pieces_) - F.col("before")))
        used = written(used.withColumns({"full": F.floor(F.col("take") / F.col("each")), "rest": F.col("take") % F.col("each")}), "sweep")
        row = lambda rank, first, i: F.struct(F.lit(length).cast("long").alias("length"), rank.cast("long").alias("rank"), first.cast("long").alias("sequence"), (capacity - F.col("room") + i * length).cast("long").alias("offset"))  # noqa: B023, E731
        slots = lambda n, make: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)).cast("int")), lambda i: i < n), make)
        whole = slots(F.when(F.col("full") > 0, F.col("each")).otherwise(0), lambda i: row(F.col("before") + i * F.col("full"), F.col("first"), i))
        part = slots(F.col("rest"), lambda i: row(F.col("before") + F.col("each") * F.col("full") + i, F.col("first") + F.col("full"), i))
        found = used.select(F.explode(F.concat(whole, part)).alias("x")).select("x.*")
        intervals = found if intervals is None else intervals.unionByName(found)
        touched = F.col("full") + (F.col("rest") > 0).cast("long")
        order = F.lit(step + 1).cast("long") * (1 << 40)  # within a room, runs stand in the order in which they came
        gap = lambda room, first, n, nth: F.struct(room.cast("long").alias("room"), first.cast("long").alias("first"), n.cast("long").alias("n"), nth.cast("long").alias("nth"))
        after = used.select(F.explode(F.array(
            gap(F.col("room") - F.col("each") * length, F.col("first"), F.col("full"), order + F.col("before") * 2),
            gap(F.col("room") - F.col("rest") * length, F.col("first") + F.col("full"), (F.col("rest") > 0).cast("long"), order + F.col("before") * 2 + 1),
            gap(F.col("room"), F.col("first") + touched, F.when(F.col("room") < capacity, F.col("n") - touched).otherwise(0), F.col("nth")),
        )).alias("g")).select("g.*")
        gone = used.select("room", "nth")
        gaps = written(gaps.join(gone, ["room", "nth"], "left_anti").select("room", "first", "n", "nth").unionByName(after).where("room > 0 and n > 0"), "gaps")
    return intervals


def op3_best_fit(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """Every piece of docs(doc_id, text) with its sequence and its offset there."""
    spark = docs.sparkSession
    cut = written(pieces(id_and_text(docs), tokenizer, capacity), "pieces")
    by_part = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    by_length = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table, _ = plan(by_length, capacity)
    order = table[:, 0] * (1 << 44) + table[:, 1]  # lengths and ranks in one sorted key
    held = spark.sparkContext.broadcast((order, table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = cut.join(before.select("length", "part", F.coalesce("before", F.lit(0)).alias("before")), ["length", "part"])
    schema = pa.schema([*list(_PIECE)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches) -> Iterator[pa.RecordBatch]:
        order, ranks, sequence, offset = held.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            at = np.searchsorted(order, length * (1 << 44) + rank, side="right") - 1
            yield record(schema, *b.columns[:5], sequence[at] + rank - ranks[at], offset[at])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
