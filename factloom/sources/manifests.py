"""Dependency manifests, lock files, package databases, advisories and deployment files as rows.

Files come as (path, content) rows and are parsed one at a time in Arrow batches; what can't be parsed gives a warning
row and never fails the scan. Versions stay as written.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ship

Row = tuple  # (ecosystem, name, version, direct)


def requirements(text: str) -> Iterator[Row]:
    for line in text.splitlines():
        m = re.match(r"\s*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?\s*(?:===?\s*([^\s;#,]+))?", line.split("#")[0])
        if m:
            yield "pypi", m[1], m[2], True


def pyproject(text: str) -> Iterator[Row]:
    spec = tomllib.loads(text)
    for line in spec.get("project", {}).get("dependencies", []):
        yield from requirements(line)
    for name, v in spec.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
        if name != "python":
            yield "pypi", name, v if isinstance(v, str) else v.get("version"), True


def toml_lock(ecosystem: str):
    def read(text: str) -> Iterator[Row]:
        for p in tomllib.loads(text).get("package", []):
            yield ecosystem, p["name"], p.get("version"), False

    return read


def cargo(text: str) -> Iterator[Row]:
    spec = tomllib.loads(text)
    for table in ("dependencies", "dev-dependencies", "build-dependencies"):
        for name, v in spec.get(table, {}).items():
            yield "cargo", name if isinstance(v, str) else v.get("package", name), v if isinstance(v, str) else v.get("version"), True


def package_json(text: str) -> Iterator[Row]:
    spec = json.loads(text)
    for table in ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies"):
        for name, v in (spec.get(table) or {}).items():
            yield "npm", name, v, True


def package_lock(text: str) -> Iterator[Row]:
    spec = json.loads(text)
    for place, p in (spec.get("packages") or {}).items():
        if place:
            yield "npm", p.get("name") or place.rpartition("node_modules/")[2], p.get("version"), False
    if not spec.get("packages"):
        for name, p in (spec.get("dependencies") or {}).items():
            yield "npm", name, p.get("version"), False


def yarn_lock(text: str) -> Iterator[Row]:
    for head, version in re.findall(r'^"?((?:@[^/@\s]+/)?[^@\s"]+)@[^\n]*:\n(?:[^\n]*\n)*?\s+version:?\s+"?([^"\s]+)', text, re.MULTILINE):
        yield "npm", head, version, False


def pnpm_lock(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"^\s+'?/?((?:@[^/@\s]+/)?[^@\s:'(]+)@([^\s:'(]+)(?:\([^)]*\))*'?:\s*$", text, re.MULTILINE):
        yield "npm", name, version, False


def go_mod(text: str) -> Iterator[Row]:
    for name, version, rest in re.findall(r"^\s*(?:require\s+)?([\w.-]+\.[\w.-]+/\S+|[\w.-]+\.[a-z]+/\S*)\s+(v\S+)(.*)$", text, re.MULTILINE):
        yield "go", name, version, "indirect" not in rest


def go_sum(text: str) -> Iterator[Row]:
    for name, version in sorted(set(re.findall(r"^(\S+)\s+(v[^\s/]+)(?:/go\.mod)?\s+h1:", text, re.MULTILINE))):
        yield "go", name, version, False


def pom(text: str) -> Iterator[Row]:
    root = ElementTree.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
    properties = {p.tag: p.text or "" for p in root.findall("properties/*")}
    fill = lambda s: re.sub(r"\$\{([^}]+)\}", lambda m: properties.get(m[1], m[0]), s) if s else s
    for d in root.iterfind(".//dependency"):
        yield "maven", f"{fill(d.findtext('groupId'))}:{fill(d.findtext('artifactId'))}", fill(d.findtext("version")), True


def gradle(text: str) -> Iterator[Row]:
    for group, name, version in re.findall(r"(?:implementation|api|compileOnly|runtimeOnly|testImplementation|compile)\s*\(?\s*['\"]([^:'\"]+):([^:'\"]+)(?::([^'\"]+))?['\"]", text):
        yield "maven", f"{group}:{name}", version or None, True


def gemfile_lock(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"^ {4}(\S+) \(([^)]+)\)$", text, re.MULTILINE):
        yield "gem", name, version, False


def composer_lock(text: str) -> Iterator[Row]:
    spec = json.loads(text)
    for p in [*(spec.get("packages") or []), *(spec.get("packages-dev") or [])]:
        yield "composer", p["name"], p.get("version"), False


def composer_json(text: str) -> Iterator[Row]:
    spec = json.loads(text)
    for table in ("require", "require-dev"):
        for name, v in (spec.get(table) or {}).items():
            if "/" in name:
                yield "composer", name, v, True


def csproj(text: str) -> Iterator[Row]:
    for p in ElementTree.fromstring(text).iter():
        if p.tag.rpartition("}")[2] == "PackageReference" and p.get("Include"):
            yield "nuget", p.get("Include"), p.get("Version") or p.findtext("Version"), True


def nuget_lock(text: str) -> Iterator[Row]:
    for table in json.loads(text).get("dependencies", {}).values():
        for name, p in table.items():
            yield "nuget", name, p.get("resolved"), p.get("type") == "Direct"


def podfile_lock(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"^  - \"?([^\s(\"]+) \(([^)]+)\)", text, re.MULTILINE):
        yield "cocoapods", name, version, False


def pubspec_lock(text: str) -> Iterator[Row]:
    for name, body in re.findall(r"^  (\w+):\n((?: {4}.*\n?)+)", text, re.MULTILINE):
        if m := re.search(r'version: "([^"]+)"', body):
            yield "pub", name, m[1], '"direct' in body


def swift_resolved(text: str) -> Iterator[Row]:
    spec = json.loads(text)
    for p in spec.get("pins") or spec.get("object", {}).get("pins", []):
        yield "swift", p.get("identity") or p.get("package"), p.get("state", {}).get("version"), False


def conan(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"^\s*([\w.+-]+)/([^\s@#]+)", text, re.MULTILINE):
        yield "conan", name, version, True


def cran(text: str) -> Iterator[Row]:
    for field in re.findall(r"^(?:Depends|Imports|LinkingTo):((?:.*\n?)(?:[ \t]+.*\n?)*)", text, re.MULTILINE):
        for name, version in re.findall(r"([A-Za-z][\w.]*)\s*(?:\(\s*[<>=]+\s*([^)]+)\))?", field):
            if name != "R":
                yield "cran", name, version or None, True


def elm(text: str) -> Iterator[Row]:
    deps = json.loads(text).get("dependencies", {})
    for table, direct in (("direct", True), ("indirect", False)):
        for name, v in deps.get(table, {}).items():
            yield "elm", name, v, direct


def opam(text: str) -> Iterator[Row]:
    m = re.search(r"depends:\s*\[(.*?)\]", text, re.DOTALL)
    for name, version in re.findall(r'"([\w-]+)"(?:\s*\{[^}]*?"([^"]+)"[^}]*\})?', m[1] if m else ""):
        yield "opam", name, version or None, True


def haxelib(text: str) -> Iterator[Row]:
    for name, v in json.loads(text).get("dependencies", {}).items():
        yield "haxelib", name, v or None, True


def fpm(text: str) -> Iterator[Row]:
    for name, v in tomllib.loads(text).get("dependencies", {}).items():
        yield "fortran", name, v if isinstance(v, str) else v.get("tag"), True


def berksfile(text: str) -> Iterator[Row]:
    for name, version in re.findall(r"^\s*(?:cookbook|depends)\s+['\"]([^'\"]+)['\"](?:\s*,\s*['\"]([^'\"]+)['\"])?", text, re.MULTILINE):
        yield "chef", name, version or None, True


def dpkg_status(text: str) -> Iterator[Row]:
    for block in re.split(r"\n\s*\n", text):
        fields = dict(re.findall(r"^([A-Za-z-]+): (.*)$", block, re.MULTILINE))
        if "Package" in fields and "installed" in fields.get("Status", "installed"):
            yield "dpkg", fields["Package"], fields.get("Version"), True


def apk_installed(text: str) -> Iterator[Row]:
    for block in re.split(r"\n\s*\n", text):
        fields = dict(re.findall(r"^([A-Z]):(.*)$", block, re.MULTILINE))
        if "P" in fields:
            yield "apk", fields["P"], fields.get("V"), True


def wheel(text: str) -> Iterator[Row]:
    fields = dict(re.findall(r"^(Name|Version): (.*)$", text.split("\n\n")[0], re.MULTILINE))
    if "Name" in fields:
        yield "pypi", fields["Name"], fields.get("Version"), False


def jar_properties(text: str) -> Iterator[Row]:
    fields = dict(re.findall(r"^(groupId|artifactId|version)=(.*)$", text, re.MULTILINE))
    if {"groupId", "artifactId"} <= fields.keys():
        yield "maven", f"{fields['groupId'].strip()}:{fields['artifactId'].strip()}", fields.get("version", "").strip() or None, False


def node_module(text: str) -> Iterator[Row]:
    spec = json.loads(text)
    if spec.get("name"):
        yield "npm", spec["name"], spec.get("version"), False


#: file name pattern, is it a lock file, parser; the first that fits reads the file
PARSERS = [
    (r"[^/]*\.(?:dist|egg)-info/(?:METADATA|PKG-INFO)", True, wheel), (r"META-INF/maven/.*/pom\.properties", True, jar_properties), (r"node_modules/(?:@[^/]+/)?[^/]+/package\.json", True, node_module),
    (r"requirements[^/]*\.txt", False, requirements), (r"pyproject\.toml", False, pyproject), (r"(poetry|uv)\.lock", True, toml_lock("pypi")), (r"Cargo\.toml", False, cargo),
    (r"Cargo\.lock", True, toml_lock("cargo")), (r"package\.json", False, package_json), (r"package-lock\.json|npm-shrinkwrap\.json", True, package_lock), (r"yarn\.lock", True, yarn_lock),
    (r"pnpm-lock\.yaml", True, pnpm_lock), (r"go\.mod", False, go_mod), (r"go\.sum", True, go_sum), (r"pom\.xml", False, pom), (r"build\.gradle(\.kts)?", False, gradle),
    (r"Gemfile\.lock", True, gemfile_lock), (r"composer\.lock", True, composer_lock), (r"composer\.json", False, composer_json), (r"[^/]*\.(cs|fs|vb)proj", False, csproj),
    (r"packages\.lock\.json", True, nuget_lock), (r"Podfile\.lock", True, podfile_lock), (r"pubspec\.lock", True, pubspec_lock), (r"Package\.resolved", True, swift_resolved),
    (r"conanfile\.txt", False, conan), (r"DESCRIPTION", False, cran), (r"elm\.json", False, elm), (r"[^/]*\.opam", False, opam), (r"haxelib\.json", False, haxelib),
    (r"fpm\.toml", False, fpm), (r"Berksfile|metadata\.rb", False, berksfile), (r"(?:.*/)?var/lib/dpkg/status", True, dpkg_status), (r"(?:.*/)?lib/apk/db/installed", True, apk_installed),
]
_DDL = "ecosystem string, name string, version string, manifest_path string, direct boolean, locked boolean, warning string"
_SCHEMA = pa.schema([("ecosystem", pa.string()), ("name", pa.string()), ("version", pa.string()), ("manifest_path", pa.string()), ("direct", pa.bool_()), ("locked", pa.bool_()), ("warning", pa.string())])


def parse_manifest(path: str, text: str) -> list[tuple]:
    for pattern, locked, parser in PARSERS:
        if re.search(rf"(^|/)(?:{pattern})$", path):
            try:
                return [(e, n, v, path, d, locked, None) for e, n, v, d in parser(text)]
            except Exception as error:  # noqa: BLE001  a file that can't be read is told, not fatal
                return [(None, None, None, path, None, locked, f"manifest_parse_error: {type(error).__name__}")]
    return []


def manifests(files: DataFrame) -> DataFrame:
    """Dependencies of files(path, content): rows with a warning are files that couldn't be parsed."""
    ship(files.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in parse_manifest(p or "", c or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, _DDL)


def advisories(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(advisories, lines that couldn't be read) of a JSON Lines snapshot."""
    from factloom.operators.advisories import ADVISORY_DDL

    rows = spark.read.schema(ADVISORY_DDL + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    bad = F.col("_corrupt_record").isNotNull() | F.col("id").isNull()
    return rows.where(~bad).drop("_corrupt_record"), rows.where(bad).select("_corrupt_record")


#: File endings of the languages.
EXTENSIONS = {
    "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "java": "java", "python": "py pyi", "javascript": "js jsx mjs cjs", "typescript": "ts tsx", "go": "go", "rust": "rs", "ruby": "rb", "csharp": "cs",
    "kotlin": "kt kts", "swift": "swift", "php": "php", "shell": "sh bash", "sql": "sql", "jsp": "jsp", "objc": "m mm",
}
VENDORED = r"(^|/)(node_modules|vendor|third_party|\.git|dist|build|target|__pycache__)/|\.min\.js$|_pb2\.py$|\.pb\.go$"


def by_language(files: DataFrame, languages: list[str] | None = None, vendored: bool = False) -> DataFrame:
    """files(path, ...) with their language by ending; others, and vendored or generated ones, are left out."""
    endings = [(e, lang) for lang, es in EXTENSIONS.items() for e in es.split() if languages is None or lang in languages]
    known = F.create_map(*(F.lit(x) for pair in endings for x in pair))
    out = files.withColumn("language", F.element_at(known, F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))).where("language is not null")
    return out if vendored else out.where(~F.col("path").rlike(VENDORED))


#: Names of configuration files that rules look at, and endings of archives and compiled code.
CONFIG = r"(^|/)(web\.xml|struts[^/]*\.xml|AndroidManifest\.xml|application[^/]*\.(properties|ya?ml)|Dockerfile|docker-compose[^/]*\.ya?ml|\.env|nginx\.conf)$"
PACKED = r"\.(zip|jar|war|ear|apk|aar|whl|egg|tar|tgz|tar\.(gz|bz2|xz|zst)|gz|bz2|xz|7z|deb|rpm|iso|class|dex|dll|exe|pyc|wasm)$"


def auxiliary(files: DataFrame) -> DataFrame:
    """files(path, ...) that are configuration ("config") or archives and compiled code ("packed"), with what they are."""
    what = F.when(F.col("path").rlike(CONFIG), "config").when(F.lower("path").rlike(PACKED), "packed")
    return files.withColumn("what", what).where("what is not null")


def bumped(lines: DataFrame) -> DataFrame:
    """lines(line, name, version, fix) of manifests with the version replaced by the fix where the line names the package and
    the version; other lines stay."""
    here = F.contains("line", "name") & F.contains("line", "version") & F.col("fix").isNotNull()
    return lines.withColumn("line", F.when(here, F.replace("line", "version", "fix")).otherwise(F.col("line")))


def source_files(spark: SparkSession, path: str, languages: list[str] | None = None, vendored: bool = False) -> DataFrame:
    """(language, path, content, sha256) of the source files below a folder, by their ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    out = by_language(files, languages, vendored)
    return out.select("language", "path", F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("sha256"))


#: First bytes of file kinds.
MAGIC = [("zip", "504b0304"), ("gzip", "1f8b"), ("bzip2", "425a68"), ("xz", "fd377a585a00"), ("7z", "377abcaf271c"), ("elf", "7f454c46"), ("class", "cafebabe"), ("wasm", "0061736d"), ("pe", "4d5a"), ("pdf", "25504446"), ("png", "89504e47"), ("rpm", "edabeedb"), ("ar", "213c617263683e"), ("zstd", "28b52ffd")]


def file_type(content) -> F.Column:
    """The kind of a file by its first bytes; NULL where none fits."""
    head = F.lower(F.hex(F.substring(content, 1, 8)))
    return F.coalesce(*(F.when(F.startswith(head, F.lit(m)), k) for k, m in MAGIC))


def squash(entries: DataFrame) -> DataFrame:
    """One file system from entries(layer, path, ...): the highest layer wins, whiteouts remove what lies below."""
    from factloom.operators.rows import last_wins

    hidden = entries.where(F.col("path").rlike(r"(^|/)\.wh\.")).select(F.regexp_replace("path", r"(^|/)\.wh\.([^/]+)$", "$1$2").alias("path"), F.col("layer").alias("__from"))
    seen = last_wins(entries.where(~F.col("path").rlike(r"(^|/)\.wh\.")), "path", "layer")
    gone = hidden.groupBy("path").agg(F.max("__from").alias("__from"))
    return seen.join(gone, "path", "left").where("__from is null or __from <= layer").drop("__from")
