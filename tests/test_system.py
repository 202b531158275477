"""Graph and row operators, matching, Python facts, the service graph, reports, checkers and incremental scans."""

import json

import pytest
from pyspark.sql import functions as F

from factloom.functions import risk
from factloom.operators import checkers, graph, matching, rows, system_graph
from factloom.operators.matching import Matcher
from factloom.plans import conformance, reports, taint_scan
from factloom.sources import python_code
from factloom.streaming.rescan import FactStore, watch


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def nodes(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "node long")


def test_reach_limits_and_shapes(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (3, 3), (1, 4), (4, 5), (2, 5), (1, 2)])
    pick = lambda r: {(x.node, x.depth) for x in r[0].collect()}
    assert pick(graph.reach(e, nodes(spark, 1), 9)) == {(1, 0), (2, 1), (4, 1), (3, 2), (5, 2)}
    assert graph.reach(e, nodes(spark, 1), 9)[1] == "complete"
    found, state = graph.reach(e, nodes(spark, 1), 1)
    assert pick((found,)) == {(1, 0), (2, 1), (4, 1)} and state == "depth_limit"
    assert graph.reach(e, nodes(spark, 1), 2)[1] == "complete"  # the limit is met exactly
    assert graph.reach(e, nodes(spark, 1), 9, max_visits=2)[1] == "visit_limit"
    assert pick(graph.reach(e, nodes(spark, 5), 9, backward=True)) == {(5, 0), (4, 1), (2, 1), (1, 2), (3, 3)}
    assert pick(graph.reach(e, nodes(spark, 7), 9)) == {(7, 0)}
    assert graph.reach(e.limit(0), nodes(spark), 9)[0].count() == 0
    assert {r.node for r in graph.slice_between(e, nodes(spark, 4), nodes(spark, 5), 9).collect()} == {4, 5}


def test_components_and_paths(spark):
    e = edges(spark, [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)])
    assert {(r.node, r.root) for r in graph.components(e).collect()} == {*((i, 0) for i in range(41)), (100, 100), (101, 100)}
    paths = graph.shortest_paths(edges(spark, [(1, 3), (1, 2), (2, 4), (3, 4)]), nodes(spark, 1), 9)
    assert {r.node: r.path for r in paths.collect()}[4] == [1, 2, 4]
    for local in (0, 100):
        scc = graph.strong_components(edges(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (4, 5), (6, 6)]), local)
        assert {(r.node, r.root) for r in scc.collect()} == {(1, 2), (2, 2), (3, 4), (4, 4), (5, 5), (6, 6)}
    labels = graph.union_by_labels(spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "node long, label string"), edges(spark, [(1, 2), (2, 3)]))
    assert {r.node: r.labels for r in labels.collect()} == {1: ["a", "b"], 2: ["a", "b"], 3: ["a", "b"], 9: ["c"]}


def test_islands_touch_overlap_nest_and_are_open(spark):
    r = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 4, 4), ("a", 7, 9), ("b", None, 2), ("b", 1, 5), ("c", 5, None), ("c", 9, 10)], "k string, lo int, hi int")
    assert {tuple(x) for x in rows.islands(r, "k", "lo", "hi").collect()} == {("a", 1, 5, 3), ("a", 7, 9, 1), ("b", None, 5, 2), ("c", 5, None, 2)}


def test_wins_and_names(spark):
    r = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, None)], "id string, ord int, v string")
    assert {tuple(x) for x in rows.last_wins(r, "id", "ord").collect()} == {("a", 3, "y"), ("b", 2, None)}
    assert {tuple(x) for x in rows.first_wins(r, ["id"], "ord").collect()} == {("a", 1, "x"), ("b", 2, None)}
    assert [tuple(x) for x in rows.unique_names(r, "id", ["v"]).collect()] == [("b", None)]
    assert [x.p for x in spark.createDataFrame([("/a//b/c",)], "u string").select(rows.prefixes(F.col("u")).alias("p")).collect()] == [["a", "a/b", "a/b/c"]]


CALL = dict(language="java", func_id=1, inst=1, function_name="f", callee_name="a.B.run", method_name="run", receiver_type="B", receiver_type_candidates=["A", "B2"], receiver_parameter=0, receiver_origin="x.get", arg_count=2, arg_types=["int", None], arg_type_candidates=[[], ["T1", "T2"]])


@pytest.mark.parametrize(
    "matcher, hits",
    [
        (Matcher(exact="a.B.run"), True), (Matcher(exact="a.B"), False), (Matcher(contains="B.r"), True), (Matcher(regex="^a.*n$"), True), (Matcher(regex="^B"), False),
        (Matcher(method_name="run"), True), (Matcher(method_contains="u", method_regex="^r"), True), (Matcher(receiver_type="A"), True), (Matcher(receiver_type="C"), False),
        (Matcher(receiver_contains="B", receiver_regex="^A$"), True), (Matcher(receiver_parameter=1), False), (Matcher(arg_count=2), True), (Matcher(arg_count_min=3), False), (Matcher(arg_count_max=2), True),
        (Matcher(arg_types=["int"]), True), (Matcher(arg_types=[None, "T2"]), True), (Matcher(arg_types=["int", "T3"]), False), (Matcher(arg_type_regexes=[None, "^T1$"], arg_types=[None, "T2"]), True),
        (Matcher(arg_types=[None, None, "X"]), False), (Matcher(receiver_origin_regex="get"), True), (Matcher(containing_function_regex="g"), False),
    ],
)
def test_every_matcher_field(spark, matcher, hits):
    calls = spark.createDataFrame([tuple(CALL.values())], matching.CALL_DDL)
    assert matching.match_calls(calls, matching.rules_frame(spark, [("r", None, matcher)])).count() == hits
    assert matching.match_calls(calls, matching.rules_frame(spark, [("r", "c", matcher)])).count() == 0


def test_unknown_facts_fail_constraints(spark):
    bare = {k: None for k in CALL} | {"language": "java", "callee_name": "f"}
    calls = spark.createDataFrame([tuple(bare.values())], matching.CALL_DDL)
    rules = [("m", None, Matcher(method_name="f")), ("n", None, Matcher(arg_count_min=0)), ("t", None, Matcher(receiver_regex=".*")), ("o", None, Matcher(receiver_origin_regex=".*")), ("y", None, Matcher(exact="f"))]
    assert [r.rule_id for r in matching.match_calls(calls, matching.rules_frame(spark, rules)).collect()] == ["y"]
    with pytest.raises(ValueError):
        Matcher().check()


def test_ports(spark):
    for port, arity, want in (("arg1", 0, ["arg1"]), ("args_from1", 3, ["arg1", "arg2"]), ("args_from3", 3, []), ("args0..=5", 2, ["arg0", "arg1"]), ("args1..=2", 0, []), ("return", 1, ["return"]), ("named:x", 2, ["named:x"])):
        got = spark.createDataFrame([(port, arity)], "p string, n int").select(matching.expand_ports(F.col("p"), F.col("n")).alias("x")).first().x
        assert got == want, port
    assert matching.parse_port("args1..=2") == ("args", 1, 2) and matching.parse_port("named_or_all:x") == ("named_or_all", "x")
    for bad in ("args2..=1", "argx", "named: ", ""):
        with pytest.raises(ValueError):
            matching.parse_port(bad)


def test_conditions(spark):
    row = spark.createDataFrame([(["sql"], ["int", None], [None, "'x'"], "R", None)], "kinds array<string>, arg_types array<string>, arg_constants array<string>, receiver_type string, receiver_constant string")
    holds = lambda c: row.select(matching.condition(c).alias("x")).first().x
    assert holds(("has_kind", "sql")) and not holds(("has_kind", "cmd")) and holds(("is_type", "arg0", "int", None)) and holds(("is_type", "receiver", None, "^R"))
    assert holds(("is_constant", "arg1")) and not holds(("is_constant", "arg0")) and not holds(("is_constant", "return")) and holds(("value_matches", "arg1", None, "x"))
    assert holds(("not", ("any", []))) and holds(("all", [])) and holds(("all", [("has_kind", "sql"), ("not", ("is_constant", "arg9"))]))


def test_risk_and_labels(spark):
    one = spark.createDataFrame([(1,)], "x int")
    score = lambda s, reach, exploit, fix: one.select(risk.risk_score(F.lit(s), F.lit(reach), F.lit(exploit), F.lit(fix)).alias("s")).first().s
    assert score("critical", 1.0, 1.0, True) == 100 and score("low", 0.2, 0.6, False) == 2 and score("high", 0.6, 0.6, True) == 27
    lab = lambda a, r, d: one.select(risk.apply_labels(*(F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (a, r, d))).alias("l")).first().l
    assert lab(["sql"], ["sql"], []) == [] and lab(["generic"], ["sql"], ["x"]) == ["generic", "neutralized:sql", "x"]
    live = lambda a, k: one.select(risk.live_for(F.array(*map(F.lit, a)), F.lit(k)).alias("l")).first().l
    assert live(["generic"], "sql") and not live(["generic", "neutralized:sql"], "sql") and live(["generic", "neutralized:sql"], "cmd") and live(["sql"], "generic") and live(["sql"], " ")


CODE = '''
import os

def clean(x):
    return escape(x)

def run(cmd):
    os.system(cmd)

def main():
    value = os.getenv("X")
    text = "echo " + value
    run(text)
    os.system("fixed")
    os.popen(clean(value))
'''


def test_python_source_to_finding(spark):
    files = spark.createDataFrame([(1, "a.py", CODE), (2, "bad.py", "def ("), (3, "safe.py", "import os\nos.system(input_name)\n")], "file_id long, path string, content string")
    kind = lambda f, k: f.withColumn("kind", F.lit(k))
    sources = kind(matching.rules_frame(spark, [("env", "python", Matcher(exact="os.getenv"))]), "cmd")
    sinks = kind(matching.rules_frame(spark, [("shell", "python", Matcher(regex=r"^os\.(system|popen)$"))]), "cmd")
    cleaners = kind(matching.rules_frame(spark, [("esc", None, Matcher(exact="escape"))]), "cmd")
    found = taint_scan.scan(files, sources, sinks, cleaners).collect()
    assert [(r.source_rule_id, r.sink_rule_id, r.location) for r in found] == [("env", "shell", "a.py:8")]
    assert {r.location for r in taint_scan.scan(files, sources, sinks).collect()} == {"a.py:8", "a.py:15"}
    facts = python_code.facts(files)
    assert [r.path for r in facts.where("what = 'warning'").collect()] == ["bad.py"]
    assert {r.name for r in facts.where("what = 'import'").collect()} == {"os"}


def test_branches_meet(spark):
    code = "import os\nif a:\n    x = os.getenv('A')\nelse:\n    x = 'b'\nos.system(x)\n"
    files = spark.createDataFrame([(1, "a.py", code)], "file_id long, path string, content string")
    rule = lambda n, m: matching.rules_frame(spark, [(n, None, m)]).withColumn("kind", F.lit("generic"))
    assert taint_scan.scan(files, rule("s", Matcher(exact="os.getenv")), rule("k", Matcher(exact="os.system"))).count() == 1


def test_service_graph(spark):
    n = spark.createDataFrame([("a", "svc", "A", {"x": "1", "y": "1"}, None, 0), ("a", "other", "B", {"x": "2"}, "ref", 1), ("b", "svc", "B", None, None, 2)], system_graph.NODE_DDL)
    merged = {r.id: (r.kind, r.name, r.attrs, r.code_ref) for r in system_graph.upsert(n).collect()}
    assert merged == {"a": ("svc", "A", {"x": "2", "y": "1"}, "ref"), "b": ("svc", "B", {}, None)}
    e = spark.createDataFrame([("a", "b", "calls", "low", ["1"]), ("a", "b", "calls", "high", ["0"]), ("a", "z", "calls", "low", []), ("z", "a", "calls", "low", [])], system_graph.EDGE_DDL)
    good, bad = system_graph.checked_edges(e, n)
    assert [(r.confidence, r.evidence) for r in good.collect()] == [("high", ["0", "1"])] and bad.count() == 2
    h = spark.createDataFrame([("s", "get", "/u/{id}/"), ("s", "POST", "/u")], "service string, method string, path string")
    q = spark.createDataFrame([("c", "GET", "http://s/u/:id"), ("c", "GET", "/u")], "client string, method string, path string")
    assert [(r.client, r.service, r.route) for r in system_graph.route_joins(h, q).collect()] == [("c", "s", "/u/*")]
    s = spark.createDataFrame([("a", "SELECT * FROM t JOIN `u` ON 1"), ("b", "insert into T values"), ("c", "DELETE FROM v")], "service string, sql string")
    assert {tuple(r) for r in system_graph.sql_tables(s).collect()} == {("a", "t", "read"), ("a", "u", "read"), ("b", "t", "write"), ("c", "v", "write")}
    f = spark.createDataFrame([("b1", "producer", "r", "x"), ("b1", "consumer", "k", "y"), ("b2", "producer", "r", "x")], "boundary string, side string, rule_id string, location string")
    assert [(r.boundary, r.producer_rule, r.consumer_rule) for r in system_graph.compose(f).collect()] == [("b1", "r", "k")]
    d = spark.createDataFrame([("a.b.C_d", "run_it")], "class_name string, method string")
    assert system_graph.native_bindings(d, spark.createDataFrame([("Java_a_b_C_1d_run_1it",)], "symbol string")).count() == 1
    c = spark.createDataFrame([("c.yml", "version: 3\nservices:\n  web:\n    image: nginx:1\n    ports:\n      - \"80:80\"\n  db:\n    image: pg\nvolumes:\n  x:\n")], "path string, content string")
    assert {r.name: r.attrs for r in system_graph.compose_services(c).collect()} == {"web": {"image": "nginx:1", "ports": "80:80"}, "db": {"image": "pg"}}


def test_reports(spark, tmp_path):
    f = spark.createDataFrame([("r2", "low", "m", "b.py", 2, 1, None), ("r1", "critical", 'say "x"', "a.py", 1, 5, ["CWE-1"])], reports.FINDING_DDL)
    log = json.loads("".join(r.value for r in reports.sarif(f).collect()))
    assert json.loads("".join(r.value for r in reports.sarif(f.limit(0)).collect()))["runs"][0]["results"] == []
    (run,) = log["runs"]
    assert [r["ruleId"] for r in run["results"]] == ["r1", "r2"] and [r["level"] for r in run["results"]] == ["error", "note"]
    assert run["results"][0]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 5}
    text = [r.value for r in reports.markdown(f).collect()]
    assert text[0] == "# Findings" and "| critical | 1 |" in text and text[-2:] == ['- `r1` a.py:1:5 say "x"', "- `r2` b.py:2:1 m"]
    g = [r.value for r in reports.dot(spark.createDataFrame([("a", 'x"y')], "id string, label string"), spark.createDataFrame([("a", "a", "flow")], "src string, dst string, kind string")).collect()]
    assert g[0] == "digraph facts {" and g[-1] == "}" and '  "a" [label="x\\"y"];' in g
    reports.write(f, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/frames/rule_summary").count() == 2


def test_checkers(spark):
    events = spark.createDataFrame([("call", "a.py", 3), ("flow", "a.py", 4)], "event string, path string, line int")
    report = lambda rule, line: lambda e: e.select(F.lit(rule).alias("rule_id"), F.lit("m").alias("message"), "path", (F.col("line") * line).alias("line"), F.lit(1).alias("col"))
    own = lambda n, run, kind="frontend", ev=("call",): checkers.Checker(n, kind, frozenset({"r"}), frozenset(ev), run)

    def broken(_):
        raise RuntimeError("x")

    found, told = checkers.run_all(spark, [own("ok", report("r", 1)), own("bad", report("q", 1)), own("zero", report("r", 0)), own("down", broken)], events)
    assert [(r.checker_id, r.line) for r in found.collect()] == [("ok", 3)]
    assert {r.checker_id for r in told.collect()} == {"bad", "zero", "down"}
    with pytest.raises(ValueError):
        own("x", broken, ev=("flow",))
    with pytest.raises(ValueError):
        own("x", broken, ev=("nothing",))
    with pytest.raises(RuntimeError):
        checkers.run_all(spark, [own("down", broken)], events, fail_fast=True)


def test_a_second_scan_parses_nothing(spark, tmp_path):
    frame = lambda r: spark.createDataFrame([(p, t, str(hash(t))) for p, t in r], "path string, content string, sha256 string")
    store = FactStore(spark, f"file://{tmp_path}/store")
    parse = lambda f: f.select("path", F.length("content").alias("n"))
    assert store.update(frame([("a", "x"), ("b", "yy")]), parse) == {"added": 2}
    assert store.update(frame([("a", "x"), ("b", "yy")]), parse) == {"reused": 2}
    assert store.update(frame([("a", "xxx"), ("c", "z")]), parse) == {"reparsed": 1, "removed": 1, "added": 1}
    assert {(r.path, r.n) for r in store.facts().collect()} == {("a", 3), ("c", 1)}


def test_a_scan_that_fails_leaves_nothing_behind(spark, tmp_path):
    frame = lambda r: spark.createDataFrame([(p, t, t) for p, t in r], "path string, content string, sha256 string")
    store = FactStore(spark, f"file://{tmp_path}/store")
    parse = lambda f: f.select("path", F.length("content").alias("n"))
    store.update(frame([("a", "x")]), parse)
    parse(frame([("b", "yy")])).write.parquet(f"file://{tmp_path}/store/facts/scan=lost")  # written, never committed
    assert store.update(frame([("a", "x"), ("b", "yy")]), parse) == {"reused": 1, "added": 1}
    assert sorted((r.path, r.n) for r in store.facts().collect()) == [("a", 1), ("b", 2)]
    store.commit(frame([("b", "yyy")]), None, parse, "again")
    store.commit(frame([("b", "yyy")]), None, parse, "again")
    assert sorted((r.path, r.n) for r in store.facts().collect()) == [("a", 1), ("b", 3)]


def test_rows_that_are_there_without_a_digest(spark):
    old, new = spark.createDataFrame([("a", None), ("b", "1"), ("c", "1")], "path string, h string"), spark.createDataFrame([("a", None), ("b", None), ("d", "1")], "path string, h string")
    assert {(r.path, r.status) for r in rows.snapshot_plan(old, new, "path", "h").collect()} == {("a", "reparsed"), ("b", "reparsed"), ("c", "removed"), ("d", "added")}
    paths = spark.createDataFrame([("/",), ("",), ("a//b/",)], "p string")
    assert [r.x for r in paths.select(rows.prefixes(F.col("p")).alias("x")).collect()] == [[], [], ["a", "a/b"]]


def test_the_stream_adds_facts(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    source, parse = f"file://{tmp_path}/in", lambda f: f.select("path", F.length("content").alias("n"))
    for rows_ in ([("a", "x", "1")], [("a", "x", "1"), ("b", "yy", "2")]):
        spark.createDataFrame(rows_, "path string, content string, sha256 string").write.mode("append").parquet(source)
        watch(spark, source, "path string, content string, sha256 string", store, parse, f"file://{tmp_path}/cp").awaitTermination()
    assert {(r.path, r.n) for r in store.facts().collect()} == {("a", 1), ("b", 2)}


def test_entry_and_oracles(spark, sf):
    import duckdb

    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert set(conformance.ORACLES) <= set(conformance.QUERIES)
    for name in ("finding_dedupe", "range_islands", "port_expand", "components_alias_merge", "taint_reach_pairs", "risk_score", "cache_plan", "rule_scan_lines", "lexical_mask_scan", "matcher_theta_join", "field_matcher", "function_matcher", "taint_condition", "three_valued_condition", "overload_rank", "actual_formal_binding", "module_prefix_join", "misuse_not_reported", "value_alias_roots", "field_cells", "object_catalog", "related_regions", "url_split", "dependency_findings", "os_findings", "graph_upsert", "sarif_results"):
        want = con.sql(conformance.ORACLES[name]).df()
        got = conformance.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
        key = lambda f: sorted(map(str, f.values.tolist()))
        assert key(got) == key(want), name


def test_a_file_that_comes_back_is_live(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/store")
    parse = lambda df: df.select("path", F.length("content").alias("n"))
    scan = lambda *rows: store.update(spark.createDataFrame([(p, c, c) for p, c in rows], "path string, sha256 string, content string"), parse)
    assert scan(("a", "1")) == {"added": 1}
    assert scan() == {"removed": 1} and store.units().count() == 0
    assert scan(("a", "1")) == {"added": 1}
    assert [(r.path, r.version) for r in store.units().collect()] == [("a", 3)] and store.facts().count() == 1
    assert scan(("a", "1"), ("b", "22")) == {"reused": 1, "added": 1} or store.units().count() == 2
    assert {r.n for r in store.facts().collect()} == {1, 2}
