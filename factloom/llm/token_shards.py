"""Token-id shards with a minimal perfect hash index (operator 4).

A shard is two raw files in the shared folder: `<name>.bin`, the ids of its documents one after the other as
little-endian unsigned 16-bit (vocabularies up to 65,536) or 32-bit integers, and `<name>.mph`, an index from
document keys to places in the payload. The index stores no keys: a layered hash of the key gives a slot without
collision, the slot holds a 32-bit fingerprint, the offset and the number of ids. A manifest (Parquet, written by
Spark with its commit protocol) names the files that count; what a failed attempt leaves is named nowhere.

Cases: null text is empty; a document without ids still gets the end id; null keys come first; rows that repeat a key
are told apart by their order of text; an empty table gives no shards. Other columns are not read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import blocks, id_and_text, machine, record, shared_folder, ship
from factloom.llm.memo_encode import MemoEncoder

MAGIC = b"FLIDS001"
GAMMA, LEVELS = 1.6, 40
#: Ids that are read at once where payloads stand together.
RUN = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def key_hash(ids: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """ids: int64 keys; nth: which row of that key it is (0 for the first), with 2**40 added where the key is null."""
    with np.errstate(over="ignore"):
        return mix(mix(ids.astype(np.uint64) + _GOLD) + nth.astype(np.uint64) * _GOLD)


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes: level after level a bit array in which hashes that are alone in
    their place set a bit; the others go on to the next level. The slot is the rank of the bit."""

    def __init__(self, bits: list[np.ndarray]):
        self.sizes = np.array([len(b) * 8 for b in bits], np.int64)
        self.bits = bits
        self.words = np.concatenate([np.unpackbits(b, bitorder="little") for b in bits]) if bits else np.zeros(0, np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.ranks = np.concatenate([[0], np.cumsum(self.words, dtype=np.int64)])

    @staticmethod
    def place(h: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h + np.uint64(level + 1) * _GOLD) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        bits, rest = [], h
        for level in range(LEVELS):
            if not len(rest):
                break
            size = max(64, int(len(rest) * GAMMA) + 7 & ~7)
            at = cls.place(rest, level, size)
            alone = np.bincount(at, minlength=size)[at] == 1
            b = np.zeros(size, np.uint8)
            b[at[alone]] = 1
            bits.append(np.packbits(b, bitorder="little"))
            rest = rest[~alone]
        if len(rest):
            raise ValueError("keys with equal 64-bit hashes in one shard")
        return cls(bits)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """-1 for a hash that is surely no key."""
        out = np.full(len(h), -1, np.int64)
        open_ = np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.first[level] + self.place(h[open_], level, int(size))
            hit = self.words[at] == 1
            out[open_[hit]] = self.ranks[at[hit]]
            open_ = open_[~hit]
        return out


def _fingerprint(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")


def index_bytes(h: np.ndarray, lengths: np.ndarray, width: int) -> bytes:
    hash_ = PerfectHash.build(h)
    slot = hash_.slots(h)
    prints, start, n = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u8"), np.zeros(len(h), "<u8")
    prints[slot], n[slot] = _fingerprint(h), lengths
    start[slot] = np.concatenate([[0], np.cumsum(lengths[:-1])]) if len(h) else 0
    head = json.dumps({"keys": len(h), "width": width, "levels": [len(b) for b in hash_.bits]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(4, "little"), head, *[b.tobytes() for b in hash_.bits], prints.tobytes(), start.tobytes(), n.tobytes()])


class ShardReader:
    """Constant-time access to the ids of a key in one shard."""

    def __init__(self, base: str, name: str):
        fs, path = pafs.FileSystem.from_uri(base)
        with fs.open_input_stream(f"{path}/{name}.mph") as f:
            raw = f.read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name}.mph is no index")
        size = int.from_bytes(raw[8:12], "little")
        head, at = json.loads(raw[12 : 12 + size]), 12 + size
        bits = []
        for n in head["levels"]:
            bits.append(np.frombuffer(raw, np.uint8, n, at))
            at += n
        k = head["keys"]
        self.width, self.hash = head["width"], PerfectHash(bits)
        self.prints = np.frombuffer(raw, "<u4", k, at)
        self.start = np.frombuffer(raw, "<u8", k, at + 4 * k).astype(np.int64)
        self.n = np.frombuffer(raw, "<u8", k, at + 12 * k).astype(np.int64)
        self.file = fs.open_input_file(f"{path}/{name}.bin")

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of ids; number -1 where the key isn't in the shard (but for one in 2**32)."""
        slot = self.hash.slots(h)
        ok = slot >= 0
        ok[ok] = self.prints[slot[ok]] == _fingerprint(h[ok])
        slot = np.where(ok, slot, 0)
        none = np.zeros(len(h), np.int64)
        return (np.where(ok, self.start[slot], -1), np.where(ok, self.n[slot], -1)) if len(self.n) else (none - 1, none - 1)

    def ids(self, start: int, n: int) -> np.ndarray:
        raw = self.file.read_at(n * self.width, start * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def many(self, start: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of several keys in their order; keys whose payloads stand one after the other are read at once, up to
        RUN ids."""
        k = 0
        while k < len(n):
            end, total = k + 1, int(n[k])
            while end < len(n) and start[end] == start[end - 1] + n[end - 1] and total + n[end] <= RUN:
                total += int(n[end])
                end += 1
            block, at = self.ids(int(start[k]), total), 0
            for size in n[k:end].tolist():
                yield block[at : at + size]
                at += size
            k = end

    def close(self) -> None:
        self.file.close()


def occurrence(keys: list, before: tuple) -> tuple[np.ndarray, np.ndarray, tuple]:
    """int64 keys, and which row of its key each is, of sorted keys; `before`: last key and its number of rows so far."""
    last, seen = before
    nth = np.zeros(len(keys), np.int64)
    for i, k in enumerate(keys):
        seen = seen + 1 if k == last and (i or seen) else 0
        nth[i] = seen
        last = k
    null = np.array([k is None for k in keys], bool)
    return np.array([0 if k is None else k for k in keys], np.int64), nth + (null.astype(np.int64) << 40), (last, seen)


_SHARD = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("nulls", pa.bool_()), ("documents", pa.int64()), ("ids", pa.int64())])
_SHARD_DDL = "shard int, name string, low long, high long, nulls boolean, documents long, ids long"


def write_shards(docs: DataFrame, base: str, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Tokenise docs(doc_id, text) into shards below `base`, keys ascending over the shards; returns the manifest."""
    ship(docs.sparkSession)

    def write(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = machine(MemoEncoder, tokenizer)
        width = 2 if enc.vocabulary <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        name, fs, out = f"s{part:06d}-{uuid.uuid4().hex}", None, None
        hashes, lengths, low, high, nulls, before = [], [], None, None, False, (None, 0)
        end = np.array([end_id], "<u4").tobytes()
        fresh = True
        for keys, texts in blocks(batches, keep=True):
            if out is None:
                fs, path = pafs.FileSystem.from_uri(base)
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}.bin")
            ids = [x + end for x in enc.ids(texts)]
            out.write(np.frombuffer(b"".join(ids), "<u4").astype("<u2").tobytes() if width == 2 else b"".join(ids))
            k, nth, before = occurrence(keys, (object(), 0) if fresh else before)
            fresh = False
            hashes.append(key_hash(k, nth))
            lengths.append(np.array([len(x) // 4 for x in ids], np.int64))
            known = k[nth < 1 << 40]
            nulls |= len(known) < len(k)
            if len(known):
                low, high = known[0] if low is None else low, known[-1]
        if out is not None:
            out.close()
            h, n = np.concatenate(hashes), np.concatenate(lengths)
            with fs.open_output_stream(f"{path}/{name}.mph") as f:
                f.write(index_bytes(h, n, width))
            yield record(_SHARD, [part], [name], [low], [high], [nulls], [len(h)], [int(n.sum())])

    n = max(1, docs.rdd.getNumPartitions())
    dealt = docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    manifest = f"{base}/manifest"
    dealt.mapInArrow(write, _SHARD_DDL).write.parquet(manifest)
    return docs.sparkSession.read.schema(_SHARD_DDL).parquet(manifest)


_FOUND = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_back(keys: DataFrame, base: str, manifest: DataFrame) -> DataFrame:
    """Look every row of keys(doc_id) up in the shards and digest what is stored there.

    The driver holds one manifest row for each shard (a shard is a scan partition: megabytes of text), never keys."""
    spark = keys.sparkSession
    shards = sorted(manifest.collect(), key=lambda r: r.shard)
    first = np.concatenate([[0], np.cumsum([r.ids for r in shards])]).astype(np.int64).tolist()
    names = [r.name for r in shards]
    lows = np.array([r.low if r.low is not None else -(1 << 63) for r in shards], np.int64)
    held = spark.sparkContext.broadcast((names, first, lows))

    def shard(batches) -> Iterator[pa.RecordBatch]:
        _, _, lows = held.value
        schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32())])
        for b in batches:
            k = b.column(0)
            at = np.maximum(np.searchsorted(lows, k.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="right") - 1, 0)
            if k.null_count:
                at[k.is_null().to_numpy(zero_copy_only=False)] = 0
            yield record(schema, k, pa.array(at.astype(np.int32)))

    def look_up(batches) -> Iterator[pa.RecordBatch]:
        names, first, _ = held.value
        reader, at, before, fresh = None, -1, (None, 0), True
        for b in batches:
            keys, of = b.column(0).to_pylist(), b.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(of)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(of)], strict=True):
                if lo == hi:
                    continue
                if of[lo] != at:
                    at = int(of[lo])
                    if reader:
                        reader.close()
                    reader, fresh = ShardReader(base, names[at]), True
                k, nth, before = occurrence(keys[lo:hi], (object(), 0) if fresh else before)
                fresh = False
                start, n = reader.find(key_hash(k, nth))
                if (n < 0).any():
                    raise ValueError(f"shard {names[at]} lacks a document of its range")
                crc = [zlib.crc32(ids.tobytes()) for ids in reader.many(start, n)]
                yield record(_FOUND, keys[lo:hi], start + first[at], n, crc)
        if reader:
            reader.close()

    placed = keys.mapInArrow(shard, "doc_id long, shard int")
    return placed.repartition(max(1, len(names)), "shard").sortWithinPartitions("shard", "doc_id").mapInArrow(look_up, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_shards(docs: DataFrame, tokenizer: str, base: str | None = None) -> DataFrame:
    """Write the shards and return, per document, what the files hold: doc_id, start, n_tokens, ids_crc32."""
    rows = id_and_text(docs)
    base = base or shared_folder(docs.sparkSession, "token-shards")
    return read_back(rows.select("doc_id"), base, write_shards(rows, base, tokenizer))
