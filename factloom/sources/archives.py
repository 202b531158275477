"""Recursive archive extraction with budgets, and lock-file graphs."""

from __future__ import annotations

import bz2
import gzip
import io
import json
import lzma
import re
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship, written

#: How deep archives are opened, how many entries and bytes each may hold.
DEPTH, ENTRIES, BYTES = 4, 10_000, 256 << 20
_DDL = "path string, content binary, depth int, problem string"
_SCHEMA = pa.schema([("path", pa.string()), ("content", pa.binary()), ("depth", pa.int32()), ("problem", pa.string())])


def kind_of(data: bytes) -> str | None:
    if data[:4] == b"PK\x03\x04":
        return "zip"
    if data[257:262] == b"ustar":
        return "tar"
    if data[:8] == b"!<arch>\n":
        return "ar"
    for magic, kind in ((b"\x1f\x8b", "gz"), (b"BZh", "bz2"), (b"\xfd7zXZ\x00", "xz")):
        if data.startswith(magic):
            return kind
    return None


def _bounded(stream, left: int) -> bytes:
    data = stream.read(left + 1)
    if len(data) > left:
        raise ValueError("too many bytes")
    return data


def entries(data: bytes, kind: str, max_entries: int = ENTRIES, max_bytes: int = BYTES) -> Iterator[tuple[str, bytes]]:
    """(name, content) of an archive's files; raises where a budget is exceeded or a name leaves the archive."""
    left, n = max_bytes, 0

    def safe(name: str) -> str:
        if name.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", name):
            raise ValueError("a name leaves the archive")
        return name

    if kind in ("gz", "bz2", "xz"):
        opener = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}[kind]
        yield "content", _bounded(opener(io.BytesIO(data)), left)
        return
    if kind == "ar":
        at = 8
        while at + 60 <= len(data):
            name, size = data[at : at + 16].decode("ascii", "replace").strip().rstrip("/"), int(data[at + 48 : at + 58])
            yield safe(name), data[at + 60 : at + 60 + size]
            at += 60 + size + size % 2
        return
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            files = ((i.filename, lambda i=i: z.open(i)) for i in z.infolist() if not i.is_dir())
            for name, open_ in files:
                n += 1
                if n > max_entries:
                    raise ValueError("too many entries")
                with open_() as f:
                    content = _bounded(f, left)
                left -= len(content)
                yield safe(name), content
        return
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for member in t:
            if not member.isfile():
                continue
            n += 1
            if n > max_entries:
                raise ValueError("too many entries")
            content = _bounded(t.extractfile(member), left)
            left -= len(content)
            yield safe(member.name), content


def extract(files: DataFrame, depth: int = DEPTH, max_entries: int = ENTRIES, max_bytes: int = BYTES) -> DataFrame:
    """files(path, content binary) with archives replaced by what they hold, level by level: path is
    `archive!/entry`; what can't be opened stays as a row with its problem."""
    ship(files.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data, level, problem in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = kind_of(data or b"") if problem is None else None
                rows = [(path, data, level, problem)]
                if kind and level >= depth:
                    rows = [(path, None, level, "nested too deep")]
                elif kind:
                    try:
                        rows = [(f"{path}!/{n}", c, level + 1, None) for n, c in entries(data, kind, max_entries, max_bytes)]
                    except Exception as error:  # noqa: BLE001  a bad archive is told, not fatal
                        rows = [(path, None, level, f"{type(error).__name__}: {error}"[:200])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    archive = (F.hex(F.substring("content", 1, 4)) == "504B0304") | F.hex(F.substring("content", 1, 2)).isin("1F8B", "425A") | (F.hex(F.substring("content", 1, 6)) == "FD377A585A00") | (F.hex(F.substring("content", 258, 5)) == "7573746172") | (F.hex(F.substring("content", 1, 8)) == "213C617263683E0A")
    left = files.select(F.col("path").cast("string"), F.col("content").cast("binary"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("problem"))
    done = None
    for _ in range(depth + 1):
        closed = F.coalesce(archive & F.col("problem").isNull(), F.lit(False))
        plain = left.where(~closed)
        done = plain if done is None else done.unionByName(plain)
        todo = left.where(closed)
        if todo.isEmpty():
            return done
        left = written(todo.mapInArrow(run, _DDL), "extracted")
    return done.unionByName(left)


# --- lock graphs -------------------------------------------------------------------------------------------------------
def npm_edges(text: str) -> Iterator[tuple[str, str]]:
    packages = json.loads(text).get("packages") or {}
    for place, p in packages.items():
        name = p.get("name") or place.rpartition("node_modules/")[2] if place else "root"
        for table in ("dependencies", "devDependencies", "optionalDependencies") if not place else ("dependencies", "optionalDependencies"):
            for to in p.get(table) or {}:
                yield name, to


def toml_edges(text: str) -> Iterator[tuple[str, str]]:
    """Cargo.lock and poetry.lock."""
    for p in tomllib.loads(text).get("package", []):
        deps = p.get("dependencies") or []
        for d in deps:
            yield p["name"], d.split(" ")[0] if isinstance(d, str) else d


def yarn_edges(text: str) -> Iterator[tuple[str, str]]:
    for head, body in re.findall(r'^"?((?:@[^/@\s]+/)?[^@\s"]+)@[^\n]*:\n((?:[ \t]+[^\n]*\n?)*)', text, re.MULTILINE):
        m = re.search(r"^ {2}dependencies:\n((?: {4}[^\n]*\n?)*)", body, re.MULTILINE)
        for to in re.findall(r'^ {4}"?((?:@[^/\s"]+/)?[^\s"@:]+)', m[1] if m else "", re.MULTILINE):
            yield head, to


LOCKS = {"package-lock.json": npm_edges, "npm-shrinkwrap.json": npm_edges, "Cargo.lock": toml_edges, "poetry.lock": toml_edges, "uv.lock": toml_edges, "yarn.lock": yarn_edges}


def lock_edges(files: DataFrame) -> DataFrame:
    """(manifest_path, src, dst) of the lock files among files(path, content)."""
    ship(files.sparkSession)
    schema = pa.schema([("manifest_path", pa.string()), ("src", pa.string()), ("dst", pa.string())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = LOCKS.get((path or "").rpartition("/")[2])
                try:
                    rows += [(path, s, d) for s, d in reader(text or "")] if reader else []
                except Exception:  # noqa: BLE001, S112  manifests() tells of files that don't parse
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, "manifest_path string, src string, dst string")
