"""Archives, lock graphs, platforms, rule sets, licences, distributions and the command line."""

import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from factloom import cli
from factloom.functions.platform import Platform, column, evaluate, live_code
from factloom.operators import rulesets
from factloom.plans import reports
from factloom.sources import archives


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, c in files.items():
            z.writestr(n, c)
    return out.getvalue()


def tarred(name, content):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo(name)
        info.size = len(content)
        t.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_archives_open_to_the_bottom(spark):
    deep = zipped(**{"b.tar.gz": gzip.compress(tarred("c.txt", b"x")), "a.txt": b"y"})
    rows = [("p.zip", bytearray(deep)), ("plain", bytearray(b"z")), ("bad.zip", bytearray(b"PK\x03\x04junk")), ("out.tar", bytearray(tarred("../evil", b"e"))), ("none", None)]
    got = {r.path: (bytes(r.content) if r.content is not None else None, r.problem is None) for r in archives.extract(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["p.zip!/a.txt"] == (b"y", True) and got["p.zip!/b.tar.gz!/content!/c.txt"] == (b"x", True) and got["plain"] == (b"z", True) and got["none"] == (None, True)
    assert not got["bad.zip"][1] and not got["out.tar"][1]
    few = archives.extract(spark.createDataFrame(rows[:1], "path string, content binary"), depth=1)
    assert {r.path: r.problem for r in few.collect()} == {"p.zip!/a.txt": None, "p.zip!/b.tar.gz": "nested too deep"}
    small = archives.extract(spark.createDataFrame(rows[:1], "path string, content binary"), max_entries=1)
    assert "too many entries" in small.first().problem


def test_lock_edges(spark):
    files = [
        ("x/package-lock.json", json.dumps({"packages": {"": {"dependencies": {"a": "1"}}, "node_modules/a": {"dependencies": {"b": "1"}}, "node_modules/b": {}}})),
        ("Cargo.lock", '[[package]]\nname="a"\nversion="1"\ndependencies=["b 1.0"]\n'),
        ("yarn.lock", 'a@^1:\n  version "1"\n  dependencies:\n    "@s/b" "^2"\n    c "1"\n'),
        ("poetry.lock", "{bad"),
    ]
    got = {tuple(r) for r in archives.lock_edges(spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {("x/package-lock.json", "root", "a"), ("x/package-lock.json", "a", "b"), ("Cargo.lock", "a", "b"), ("yarn.lock", "a", "@s/b"), ("yarn.lock", "a", "c")}


TREE = ("all", [("define", "A"), ("not", ("define", "B")), ("any", [("os", "linux"), ("define", "C")])])


def test_three_valued_platforms(spark):
    assert evaluate(TREE, Platform("linux", None, {"A": "1"}, frozenset("B"))) is True
    assert evaluate(TREE, Platform("linux", None, {"A": "1"})) is None and evaluate(TREE, Platform(None, None, {"B": "1"})) is False
    rows = spark.createDataFrame([(["A"], ["B"], "linux"), (["A"], [], "linux"), (["B"], [], None)], "m array<string>, u array<string>, os string")
    assert [r.x for r in rows.select(column(TREE, F.col("m"), F.col("u"), F.col("os"), F.lit(None)).alias("x")).collect()] == [True, None, False]


def test_conditional_code():
    source = "a\n#ifdef W\nw\n#elif defined(L) && V >= 2\nl\n#else\ne\n#endif\n#if UNKNOWN\nu\n#else\nv\n#endif\n"
    live = live_code(source, Platform(macros={"L": "1", "V": "3"}, undefined=frozenset({"W"})))
    assert [x for x in live.split("\n") if x.strip() and not x.startswith("#")] == ["a", "l", "u", "v"]
    assert len(live) == len(source) and live.count("\n") == source.count("\n")


def test_rule_sets(spark):
    one = spark.createDataFrame([("sources", "a", 1), ("sources", "b", 1), ("sinks", "a", 1)], "family string, id string, v int")
    two = spark.createDataFrame([("sources", "a", 2)], "family string, id string, v int")
    assert {tuple(r) for r in rulesets.merge(one, two).collect()} == {("sources", "a", 2), ("sources", "b", 1), ("sinks", "a", 1)}
    needs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "id string, needed string")
    rules = spark.createDataFrame([(i,) for i in "abcd"], "id string")
    assert {r.id for r in rulesets.retain(rules, needs, ["b"]).collect()} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        rulesets.retain(rules, needs, ["x"])


def test_literal_patterns():
    assert rulesets.literals("^(get|set)Name$") == ["getName", "setName"] and rulesets.literals("^a[bc]d?$") == ["ab", "abd", "ac", "acd"]
    assert rulesets.literals("get") is None and rulesets.literals("^a.*$") is None and rulesets.literals("^[a-z]{4}$") is None and rulesets.literals("(") is None


def test_classes_and_texts(spark):
    rows = spark.createDataFrame([("sql", "Path Traversal", " ", {"en": "e", "zh": " "}), ("odd", "Weak hashing", "LOW", {})], "kind string, text string, sev string, m map<string,string>")
    got = [tuple(r) for r in rows.select(rulesets.weakness(F.col("kind")), rulesets.category_class(F.col("text")), reports.normal_severity(F.col("sev"), F.col("kind")), rulesets.localized(F.col("m"), "zh", F.lit("f"))).collect()]
    assert got == [("CWE-89", "CWE-22", "warning", "e"), (None, "CWE-328", "LOW", "f")]


def test_licences(spark):
    corpus = spark.createDataFrame([("X", "permission is hereby granted to use this"), ("Y", "redistribution and use in source and binary forms")], "licence string, text string")
    files = spark.createDataFrame([("a", "Permission is hereby granted, to use this!"), ("b", "nothing alike"), ("c", None)], "path string, content string")
    assert [tuple(r) for r in rulesets.licences(files, corpus).collect()] == [("a", "X", 1.0)]


def test_distributions(spark):
    rows = [("i", "etc/os-release", 'ID=debian\nVERSION_ID="12"\n'), ("i", "etc/debian_version", "12.5"), ("j", "etc/alpine-release", "3.19.1\n")]
    got = {r.image: r.data_key for r in rulesets.distro(spark.createDataFrame(rows, "image string, path string, content string")).collect()}
    assert got == {"i": "debian:12", "j": "alpine:3.19"}


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "requirements.txt").write_text("foo==1.0\n")
    (tmp_path / "in" / "a.py").write_text("import os\n")
    (tmp_path / "adv.jsonl").write_text('{"id":"A","ecosystem":"pypi","package":"foo","severity":"high","vulnerable_range":"<2"}\n')
    cli.main(["scan", str(tmp_path / "in"), str(tmp_path / "adv.jsonl"), str(tmp_path / "out")])
    assert [r.rule_id for r in spark.read.json(str(tmp_path / "out/findings")).collect()] == ["A"]
    cli.main(["python-facts", str(tmp_path / "in"), str(tmp_path / "facts")])
    assert spark.read.parquet(str(tmp_path / "facts")).where("what = 'import'").count() == 1
