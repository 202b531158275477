"""Lowering of Python functions, deployment files and operating-system advisories."""

from pyspark.sql import functions as F

from factloom.operators import dataflow, os_advisories
from factloom.sources import deployment, manifests, python_code

CODE = '''
def nulls(a):
    x = None
    if a is None:
        a.run()
    else:
        a.stop()
    return x.size

def loops():
    items = [1, 2, 3]
    i = 0
    while i < 3:
        print(items[i])
        i += 1
    return items[i]

def fine():
    return 1
'''


def test_lowered_functions_are_analysed(spark):
    files = spark.createDataFrame([(7, "a.py", CODE), (8, "bad.py", "def"), (9, "none.py", None)], "file_id long, path string, content string")
    insts, cfg = python_code.lower(files)
    facts = [(r.func_id & 0xFFFF, r.fact) for r in dataflow.nullness(insts, cfg).collect()]
    assert sorted(f for k, f in facts if k == 0) == ["nonnull", "null", "null"]
    verdicts = {(r.func_id & 0xFFFF, r.verdict) for r in dataflow.index_safety(insts, cfg).collect()}
    assert verdicts == {(1, "safe"), (1, "out_of_bounds")}
    assert dataflow.validate(insts, cfg).where("problem in ('duplicate_instruction', 'undefined_value')").count() == 0
    assert {r.func_id >> 32 for r in insts.select("func_id").distinct().collect()} == {7}


def test_deployment_files(spark):
    yaml = "kind: Deployment\nmetadata:\n  labels:\n    x: y\n  name: web\nspec:\n  containers:\n  - image: nginx:1\n    ports:\n    - containerPort: 80\n---\nkind: Service\nmetadata:\n  name: web-svc\nspec:\n  ports:\n  - port: 8080\n---\n# nothing\n"
    proto = "package a.b; // x\nservice S {\n  rpc Get (Req) returns (stream Res) {}\n  rpc Put(Req) returns (Res);\n}\n"
    files = spark.createDataFrame([("k.yml", yaml), ("s.proto", proto)], "path string, content string")
    assert {(r.kind, r.name, tuple(r.images), tuple(r.ports)) for r in deployment.kubernetes(files).collect()} == {("Deployment", "web", ("nginx:1",), ("80",)), ("Service", "web-svc", (), ("8080",))}
    assert {(r.method, r.request, r.response) for r in deployment.protocol_services(files).collect()} == {("a.b.S/Get", "Req", "Res"), ("a.b.S/Put", "Req", "Res")}


def test_compile_commands_and_headers(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"directory":"/d","file":"a.c","command":"cc -Iinc -DX=1 -c a.c"},{"directory":"/d","file":"/e/b.c","arguments":["cc","-DY"]}]')
    got = {r.file: (r.includes, r.defines) for r in deployment.compile_commands(spark, str(tmp_path / "c.json")).collect()}
    assert got == {"/d/a.c": (["inc"], ["X=1"]), "/e/b.c": ([], ["Y"])}
    files = spark.createDataFrame([("p/a.c", '#include "b.h"\n#include <far.h>\n'), ("p/b.h", '#include "c.h"\n#include "two.h"'), ("p/c.h", '#include "b.h"'), ("inc/far.h", ""), ("x/two.h", ""), ("y/two.h", "")], "path string, content string")
    found = deployment.headers(files, spark.createDataFrame([("p/a.c",)], "path string"))
    assert {(r.path, r.depth) for r in found.collect()} == {("p/b.h", 1), ("inc/far.h", 1), ("p/c.h", 2)}


def test_installed_packages():
    assert manifests.parse_manifest("lib/a.dist-info/METADATA", "Name: A\nVersion: 1\n\ntext")[0][:3] == ("pypi", "A", "1")
    assert manifests.parse_manifest("x.jar!/META-INF/maven/g/a/pom.properties", "groupId=g\nartifactId=a\nversion=2\n")[0][:3] == ("maven", "g:a", "2")
    assert manifests.parse_manifest("node_modules/@s/b/package.json", '{"name":"@s/b","version":"3","dependencies":{"z":"1"}}')[0][:3] == ("npm", "@s/b", "3")


def test_operating_system_advisories(spark):
    packages = spark.createDataFrame([(["rocky:9", "rhel:9"], "b1", "src", "1.0-1"), (["rocky:9", "rhel:9"], "b2", "src", "1.0-1"), (["debian:12"], "d", None, "2.0-1")], os_advisories.PACKAGE_DDL)
    rows = [
        ("rocky:9", "src", "RLSA-1", ["CVE-1"], "high", "1.0-2", "fixed"), ("rhel:9", "src", "RHSA-1", ["CVE-1"], "low", None, "will_not_fix"), ("rhel:9", "src", "RHSA-2", ["CVE-2"], "low", None, "affected"),
        ("rhel:9", "src", "RHSA-3", ["CVE-3"], "low", "1.0-9", "fixed"), ("debian:12", "d", "DSA-1", ["CVE-4"], "critical", "2.0-1", "fixed"), ("debian:12", "d", "DSA-2", ["CVE-5", "CVE-6"], "low", "2.0-2", "fixed"),
        ("debian:12", "d", "DSA-3", ["CVE-5"], "high", None, "affected"), ("debian:12", "d", "DSA-4", ["CVE-7"], "high", None, "not_affected"), ("rocky:9", "src", "RLSA-2", ["CVE-8"], "high", "1.0-2.fips", "fixed"),
    ]
    found = os_advisories.findings(packages, spark.createDataFrame(rows, os_advisories.STATEMENT_DDL))
    got = {(r.source, r.cve): (r.severity, r.advisories, r.fixed_version, r.state, r.binaries) for r in found.collect()}
    assert got == {
        ("src", "CVE-1"): ("high", ["RLSA-1"], "1.0-2", "fixed", ["b1", "b2"]), ("src", "CVE-2"): ("low", ["RHSA-2"], None, "affected", ["b1", "b2"]),
        ("d", "CVE-5"): ("high", ["DSA-2", "DSA-3"], "2.0-2", "fixed", ["d"]), ("d", "CVE-6"): ("low", ["DSA-2"], "2.0-2", "fixed", ["d"]),
    }
    binary = spark.createDataFrame([("b1", "CVE-1"), ("zz", "CVE-1")], "binary string, cve string")
    assert [r.binary for r in os_advisories.prefer_source(found.select("binaries", "cve"), binary).collect()] == ["zz"]
    assert spark.createDataFrame([("1-fips",)], "v string").select(os_advisories.flavor(F.col("v")).alias("f")).first().f == "fips"
