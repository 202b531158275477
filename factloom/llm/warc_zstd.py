"""WARC archives of Zstandard frames with a dictionary in front (operator 12).

A file `.warc.zst` begins with a skippable frame that holds a dictionary, compressed or not, and goes on with one frame for
each record. Records are WARC/1.1: a warcinfo record, and a response for each page or, where a page with the same payload is
stored, a revisit that refers to it and repeats its digest. The reader takes the dictionary from the skippable frame, finds
the end of each frame from its block headers, decodes one frame at a time, and checks version, header lines, lengths, the
record's end and the digests; what doesn't fit is an error that names file and place.

Which page keeps a payload is found by grouping digests, never texts. Groups with more than a thousandth of all rows, so fewer
than a thousand, are broadcast and their rows dealt evenly; the other rows meet their group by shuffle.

Files are written below the shared folder and count only if the manifest, which Spark commits, names them: what a failed
attempt leaves is never read.

Cases: null html is an empty payload; payloads of fewer than `least` bytes never are revisits. Of rows that repeat the largest
id of a payload all are responses; a null id is smaller than any other and, where a payload has no other, a response. A null
url gives a record without target. Control characters, spaces and letters beyond ASCII in urls are percent-encoded. An empty
table gives no files. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import record, release, shared_folder, ship, small, written

#: Payloads of fewer bytes are never stored as revisits.
LEAST = 1000
#: Stored bytes of a file, about; bytes of a dictionary; records and bytes that a file's dictionary is made from, its first.
FILE, DICTIONARY, SAMPLES, SAMPLE_BYTES = 64 << 20, 32 << 10, 400, 4 << 20
#: Fixed values of the formats.
FRAME, SKIPPABLE, TRAINED, VERSION, END = b"\x28\xb5\x2f\xfd", b"\x5d\x2a\x4d\x18", b"\x37\xa4\x30\xec", b"WARC/1.1", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Groups of more than this share of all rows are hot.
HOT = 1000


class Damaged(ValueError):
    """A file that isn't what it should be."""


# --- frames ------------------------------------------------------------------------------------------------------------


def frame_end(data, at: int) -> int | None:
    """Where the frame at `at` ends; None if `data` ends before."""
    if len(data) < at + 6:
        return None
    if bytes(data[at : at + 4]) != FRAME:
        raise Damaged("no frame here")
    head = data[at + 4]
    single, checksum = head >> 5 & 1, head >> 2 & 1
    if head & 8:
        raise Damaged("a reserved bit is set")
    at += 5 + (not single) + (0, 1, 2, 4)[head & 3] + ((1 if single else 0), 2, 4, 8)[head >> 6]
    last = 0
    while not last:
        if len(data) < at + 3:
            return None
        block = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise Damaged("a block of a reserved kind")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checksum
    return at if len(data) >= at else None


def dictionary_of(data: bytes):
    """The dictionary that a skippable frame holds."""
    import zstandard

    if data[:4] == FRAME:
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
    if data[:4] != TRAINED:
        raise Damaged("the skippable frame holds no dictionary")
    return zstandard.ZstdCompressionDict(data)


def frames(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the frames of a file, one at a time."""
    import zstandard

    data, at, base, reader, fresh = b"", 0, 0, zstandard.ZstdDecompressor(), True
    ended = False
    while True:
        if fresh and len(data) >= 8:
            fresh = False
            if data[:4] == SKIPPABLE:
                size = 8 + int.from_bytes(data[4:8], "little")
                while len(data) < size:
                    more = next(chunks, b"")
                    if not more:
                        raise Damaged("the file ends within its dictionary")
                    data += more
                reader, at = zstandard.ZstdDecompressor(dict_data=dictionary_of(data[8:size])), size
        end = None if fresh or at == len(data) else frame_end(data, at)
        if end is not None:
            try:
                yield base + at, reader.decompress(data[at:end], max_output_size=1 << 31)
            except zstandard.ZstdError as e:
                raise Damaged(f"frame at {base + at}: {e}") from e
            at = end
            continue
        if ended:
            if at < len(data) or fresh and data:
                raise Damaged(f"the file ends within the frame at {base + at}")
            return
        more = next(chunks, b"")
        ended = not more
        data, base, at = data[at:] + more, base + at, 0


# --- records -----------------------------------------------------------------------------------------------------------


def sha1_label(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _lines(*pairs: tuple[str, str | None]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """A page as a response, or as a revisit of page `refers_to`."""
    http = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))) + b"\r\n"
    block = http + payload if refers_to is None else http
    head = _lines(
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")),
        ("WARC-Date", date),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        ("WARC-Payload-Digest", sha1_label(hashlib.sha1(payload).digest())),
        ("WARC-Block-Digest", sha1_label(hashlib.sha1(block).digest())),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    )
    return VERSION + b"\r\n" + head + b"\r\n" + block + END


def info_record(name: str, date: str) -> bytes:
    block = _lines(("format", "WARC File Format 1.1"), ("software", "factloom"))
    head = _lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + head + b"\r\n" + block + END


def headers_of(lines: bytes, what: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines.split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip() or b"\r" in line or b"\n" in line:
            raise Damaged(f"{what}: no header line: {line[:80]!r}")
        key = name.decode("utf-8", "replace").lower()
        if key in out:
            raise Damaged(f"{what}: {key} stands twice")
        out[key] = value.strip().decode("utf-8", "replace")
    return out


def length_of(headers: dict[str, str], what: str) -> int:
    n = headers.get("content-length", "")
    if not n.isascii() or not n.isdigit():
        raise Damaged(f"{what}: no length")
    return int(n)


def page_of(uri: str | None) -> int | None:
    if not uri or not uri.startswith("<urn:page:") or not uri.endswith(">"):
        raise Damaged(f"no page id: {uri!r}")
    return None if uri == "<urn:page:null>" else int(uri[10:-1])


def parsed(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of the one record that a frame holds."""
    head, found, rest = content.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not found or version != VERSION:
        raise Damaged(f"no record: {content[:20]!r}")
    headers = headers_of(lines, "record")
    for must in ("warc-type", "warc-record-id", "warc-date"):
        if not headers.get(must):
            raise Damaged(f"record: no {must}")
    n = length_of(headers, "record")
    if len(rest) != n + len(END) or rest[n:] != END:
        raise Damaged(f"record: {n} bytes are told, {len(rest) - len(END)} there")
    block = rest[:n]
    if headers.get("warc-block-digest", sha1_label(hashlib.sha1(block).digest())) != sha1_label(hashlib.sha1(block).digest()):
        raise Damaged("record: another block than its digest says")
    return headers, block


def page_fields(headers: dict[str, str], block: bytes) -> dict:
    """What a response or revisit record says of its page. A revisit's payload is empty here; its length and digest are told."""
    http, found, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not found or not status.startswith(b"HTTP/"):
        raise Damaged("record: no HTTP message")
    n, label, kind = length_of(headers_of(lines, "message"), "message"), headers.get("warc-payload-digest", ""), headers["warc-type"]
    if not label.startswith("sha1:"):
        raise Damaged("record: no payload digest")
    digest = base64.b32decode(label[5:])
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).digest() != digest):
        raise Damaged("record: another payload than its length and digest say")
    if kind == "revisit" and (payload or headers.get("warc-profile") != PROFILE):
        raise Damaged("record: a revisit of another kind")
    refers_to = page_of(headers.get("warc-refers-to")) if kind == "revisit" else None
    return {"page_id": page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": refers_to, "payload_bytes": n, "payload_digest": digest.hex(), "payload": payload}


# --- archives ----------------------------------------------------------------------------------------------------------


class ArchiveFile:
    """One file while it is written. The first records wait until there are enough for a dictionary."""

    def __init__(self, base: str, date: str):
        self.name = f"w-{uuid.uuid4().hex}.warc.zst"
        self.fs, path = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(path, recursive=True)
        self.out = self.fs.open_output_stream(f"{path}/{self.name}", compression=None)  # else the name would have it compressed once more
        self.waiting: list[bytes] = [info_record(self.name, date)]
        self.waiting_bytes = self.bytes = self.records = 0
        self.frames = None

    def add(self, content: bytes) -> None:
        self.records += 1
        if self.frames is not None:
            self.put(content)
            return
        self.waiting.append(content)
        self.waiting_bytes += len(content)
        if len(self.waiting) > SAMPLES or self.waiting_bytes >= SAMPLE_BYTES:
            self.begin()

    def put(self, content: bytes) -> None:
        frame = self.frames.compress(content)
        self.out.write(frame)
        self.bytes += len(frame)

    def begin(self) -> None:
        import zstandard

        samples = [w[: 64 << 10] for w in self.waiting[1:]]
        found = None
        if len(samples) >= 8 and sum(map(len, samples)) >= 4 * DICTIONARY:
            try:
                found = zstandard.train_dictionary(DICTIONARY, samples)
            except zstandard.ZstdError:  # too little in common: a file without dictionary
                found = None
        if found is not None:
            stored = zstandard.ZstdCompressor(level=9).compress(found.as_bytes())
            self.out.write(SKIPPABLE + len(stored).to_bytes(4, "little") + stored)
            self.bytes += 8 + len(stored)
        self.frames = zstandard.ZstdCompressor(level=3, dict_data=found, write_checksum=True, write_content_size=True) if found else zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        for w in self.waiting:
            self.put(w)
        self.waiting, self.waiting_bytes = [], 0

    def close(self) -> None:
        if self.frames is None:
            self.begin()
        self.out.close()


_FILE = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_FILE_DDL = "name string, records long, bytes long"


def write_archives(rows: DataFrame, base: str, date: str, limit: int = FILE) -> DataFrame:
    """Write rows(page_id, url, payload binary, refers_to) below `base`; returns the manifest (name, records, bytes)."""
    ship(rows.sparkSession)

    def write(batches) -> Iterator[pa.RecordBatch]:
        release()
        file = None
        for b in batches:
            for page, url, payload, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                file = file or ArchiveFile(base, date)
                file.add(page_record(page, url, payload, refers_to, date))
                if file.bytes + file.waiting_bytes >= limit:
                    file.close()
                    yield record(_FILE, [file.name], [file.records], [file.bytes])
                    file = None
        if file:
            file.close()
            yield record(_FILE, [file.name], [file.records], [file.bytes])

    return written(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(write, _FILE_DDL), "warc-manifest")


_PAGE = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
_PAGE_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def file_pages(base: str, name: str, chunk: int = 1 << 20) -> Iterator[dict]:
    """The pages of one file, checked."""
    fs, path = pafs.FileSystem.from_uri(base)
    with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
        at = 0
        try:
            for at, content in frames(iter(lambda: f.read(chunk), b"")):
                headers, block = parsed(content)
                if headers["warc-type"] in ("response", "revisit"):
                    yield page_fields(headers, block)
        except Damaged as e:
            raise Damaged(f"{name}, after {at}: {e}") from e


def read_archives(manifest: DataFrame, base: str, payloads: bool = True, lot: int = 4 << 20) -> DataFrame:
    """The pages of the files that manifest(name, records) names; a file with another number of records is an error.
    payloads: give the payloads of responses as well."""
    ship(manifest.sparkSession)
    schema = pa.schema(_PAGE if payloads else _PAGE[:-1])

    def read(batches) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            for name, records in zip(b.column("name").to_pylist(), b.column("records").to_pylist(), strict=True):
                rows: list[dict] = []
                size = seen = 0
                for page in file_pages(base, name):
                    rows.append(page)
                    seen += 1
                    size += (len(page["payload"]) if payloads else 0) + 200
                    if size >= lot:
                        yield record(schema, *([r[c] for r in rows] for c in schema.names))
                        rows, size = [], 0
                if seen != records:
                    raise Damaged(f"{name}: {records} records are told, {seen} there")
                if rows:
                    yield record(schema, *([r[c] for r in rows] for c in schema.names))

    files = manifest.select("name", "records")
    return files.repartition(max(1, files.count())).mapInArrow(read, _PAGE_DDL if payloads else _PAGE_DDL.rpartition(",")[0])


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """pages(page_id, url, html) as (page_id, url, payload, refers_to): of equal payloads of at least `least` bytes the row with
    the largest id stays, the others refer to it."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null")
    groups = written(groups, "warc-groups")
    total = pages.count()
    hot = groups.where(F.col("n") * HOT > total).select("digest", F.col("keep").alias("hot_keep"))  # fewer than HOT rows
    met = rows.join(F.broadcast(hot), "digest", "left")
    # rows that are decided are dealt evenly instead of by their digest
    alone = F.concat(F.lit("-"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    keyed = met.withColumn("key", F.when(F.col("digest").isNull() | F.col("hot_keep").isNotNull(), alone).otherwise(F.col("digest")))
    cold = groups.where(F.col("n") * HOT <= total).select(F.col("digest").alias("key"), F.col("keep").alias("cold_keep"))
    found = keyed.join(small(cold), "key", "left").withColumn("keep", F.coalesce("hot_keep", "cold_keep"))
    return found.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")).alias("refers_to"))


def op12_warc(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", base: str | None = None) -> DataFrame:
    """Write the archives and return, for each page, what they hold: page_id, payload_bytes, payload_digest, record_type,
    refers_to."""
    base = base or shared_folder(pages.sparkSession, "warc")
    found = read_archives(write_archives(revisits(pages), base, date), base, payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
