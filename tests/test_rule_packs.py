"""Rule packs: loading, what is left out, text findings, taint from the command line."""

import json

import pytest

from factloom import cli
from factloom.sources import rule_packs

TAINT = """
sources:
- {id: env, language: python, matcher: {exact: os.getenv}, out: return, kind: generic}
- {id: env, language: python, matcher: {exact: other}, out: return, kind: later}
- {id: fill, language: python, matcher: {method_name: recv_into}, out: arg0}
- {id: odd, matcher: {sounds_like: x}, out: return}
- {id: nowhere, matcher: {exact: x}, out: somewhere}
sinks:
- {id: shell, language: python, matcher: {exact: os.system}, inputs: [arg0], kind: command}
- {id: second, matcher: {exact: log.write}, inputs: [arg1], kind: log}
- {id: bad, matcher: {regex: "("}, inputs: [arg0]}
sanitizers:
- {id: quote, matcher: {exact: shlex.quote}, kind: command}
"""
TEXT = """
id: own
title: Own rules
rules:
- id: KEY
  title: A key
  languages: []
  severity: error
  pattern: 'KEY-[0-9]+'
  cwe: [CWE-321, CWE-798]
  message: Remove it.
  matcher: {matched_text_not_pattern: 'KEY-0$'}
- {id: GETS, title: gets, languages: [c, cpp], severity: warning, pattern: '\\bgets\\s*\\(', matcher: {exclude_preprocessor: true, required_file_pattern: stdio}}
- {id: CALL, title: structured, severity: note, pattern: x, matcher: {callee: x, min_args: 2}}
"""
CODE = "import os, shlex, sock, log\nx = os.getenv('A')\nos.system(x)\nos.system(shlex.quote(x))\nlog.write(x, 'fine')\nlog.write('fine', x)\nbuf = make()\nsock.recv_into(buf)\nos.system(buf)\n"


@pytest.fixture
def packs(tmp_path):
    if rule_packs.yaml is None:
        pytest.skip("no YAML reader")
    (tmp_path / "taint.yml").write_text(TAINT)
    (tmp_path / "text.yml").write_text(TEXT)
    return str(tmp_path / "taint.yml"), str(tmp_path / "text.yml")


def test_packs_tell_what_they_leave_out(packs, capsys):
    pack = rule_packs.read(*packs)
    assert [r[0] for r in pack.sources] == ["env", "fill"] and [r[0] for r in pack.sinks] == ["shell", "second"]
    assert {i for i, _ in pack.skipped} == {"odd", "nowhere", "bad", "CALL"}
    cli.main(["check-rules", ",".join(packs)])
    assert "2 sources, 2 sinks, 1 sanitizers, 2 text rules, 4 left out" in capsys.readouterr().out
    with pytest.raises(ValueError):
        rule_packs.add(rule_packs.Pack(), [])


def test_json_packs(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"sinks": [{"id": "k", "matcher": {"exact": "f"}, "inputs": ["arg0"]}]}))
    assert rule_packs.read(str(tmp_path / "a.json")).sinks[0][3] == "generic"


def test_text_rules_of_a_pack(spark, packs):
    rows = [("c", "a.c", "#include <stdio.h>\n#define x gets(y)\n gets (z); gets(z);"), ("c", "b.c", "gets(a)"), ("text", "k", "KEY-12 KEY-0 KEY-7"), ("cpp", "c.cc", "stdio; gets(b)")]
    found = rule_packs.scan_texts(spark.createDataFrame(rows, "language string, path string, content string"), rule_packs.read(packs[1]))
    assert {(r.rule_id, r.path, r.line, r.col, r.match, r.cwe) for r in found.collect()} == {("GETS", "a.c", 3, 2, "gets (", None), ("GETS", "a.c", 3, 12, "gets(", None), ("GETS", "c.cc", 1, 8, "gets(", None), ("KEY", "k", 1, 1, "KEY-12", "CWE-321,CWE-798"), ("KEY", "k", 1, 14, "KEY-7", "CWE-321,CWE-798")}


def test_taint_from_the_command_line(spark, packs, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text(CODE)
    (tmp_path / "src" / "b.py").write_text("import os\nos.system(name)\n")
    cli.main(["taint", str(tmp_path / "src"), packs[0], str(tmp_path / "out")])
    found = {(r.source_rule_id, r.sink_rule_id, r.location.rpartition("/")[2]) for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert found == {("env", "shell", "a.py:3"), ("env", "second", "a.py:6"), ("fill", "shell", "a.py:9")}
