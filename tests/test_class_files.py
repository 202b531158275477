"""Class files: what javap lists, values along the stack, collections of compiled code."""

import json
import random
import re
import shutil
import struct
import subprocess
import zipfile
from collections import defaultdict
from pathlib import Path

import pyspark
import pytest
from pyspark.sql import functions as F

from factloom.operators import calls, containers, flow, matching, receiver_labels
from factloom.operators.congruence import NotFinished
from factloom.operators.matching import Matcher
from factloom.plans import class_scan, reports
from factloom.sources import archives, class_files

JAVA = """
import java.util.*;
import java.util.function.*;

abstract class Base implements Comparable<Base> {
    static native int outside(long handle);
    abstract void open();
}

class Sample {
    static long total;
    double weight;

    static String lists(String bad, String good) {
        ArrayList<String> list = new ArrayList<>();
        list.add(good);
        list.add(bad);
        list.set(0, good);
        String one = list.get(0);
        String two = list.get(1);
        sink(one);
        sink(two);
        Map<String, String> map = new HashMap<>(16);
        map.put("a", bad);
        map.put("b", good);
        sink(map.get("b"));
        sink((String) map.get("a"));
        return one;
    }

    static String escapes(String bad, String good, int at) {
        List<String> list = new LinkedList<>();
        list.add(bad);
        pass(list);
        sink(list.get(0));
        ArrayList<String> other = new ArrayList<>();
        other.add(bad);
        return other.get(at);
    }

    static void pass(List<String> l) {}
    static void sink(Object o) {}

    static int choose(boolean c, int a, int b) {
        int x = c ? a : b;
        return x;
    }

    static int same(boolean c, int a) {
        int x = c ? a : a;
        return x;
    }

    static int loop(int n, int seed) {
        int x = seed;
        for (int i = 0; i < n; i++) x = x + i;
        return x;
    }

    static String guarded(String s, Supplier<String> f) {
        String r = null;
        try {
            r = f.get();
            r = s.trim();
        } catch (IllegalStateException e) {
            r = e.getMessage();
        } finally {
            total++;
        }
        return r;
    }

    long wide(long a, double d, long[] cells, int k) {
        cells[k] += a;
        total += cells[k]++;
        weight *= d;
        long[][] grid = new long[k][3];
        grid[0][1] = -a << 2;
        return a > 3L ? cells[k] : (long) d;
    }

    static int cases(String s, int k) {
        switch (k) { case 1: return 1; case 2: return 7; case 900: k = 3; default: k += 70000; }
        switch (s) { case "x": return 1; case "y": break; }
        synchronized (s) { k++; }
        return s instanceof String ? k : ~k;
    }

    static Function<String, Integer> lambdas(int k) {
        Function<String, Integer> f = t -> t.length() + k;
        Supplier<Sample> g = Sample::new;
        String text = "n" + k + g;
        return f;
    }
}
"""


@pytest.fixture(scope="module")
def compiled(tmp_path_factory):
    if not shutil.which("javac") or not shutil.which("javap"):
        pytest.skip("needs a Java compiler")
    at = tmp_path_factory.mktemp("java")
    (at / "Sample.java").write_text(JAVA)
    subprocess.run(["javac", "-g", "-nowarn", "-d", str(at), str(at / "Sample.java")], check=True, capture_output=True)
    return at


def listed(files: list[Path]) -> set[tuple]:
    """(class, place, owner.name:descriptor) of calls, as javap tells."""
    out, own = set(), None
    text = subprocess.run(["javap", "-c", "-p", *map(str, files)], check=True, capture_output=True, text=True).stdout
    for line in text.splitlines():
        m = re.match(r"(?:.* )?(?:class|interface) ([\w.$]+)", line)
        if m and not line.startswith(" "):
            own = m[1]
        m = re.match(r"\s+(\d+): invoke(\w+)\s+#\d+(?:,\s+\d+)?\s+// (?:Interface)?Method (\S+)", line)
        if m:
            name = m[3].replace('"', "")
            owner, _, rest = name.partition(":")[0].rpartition(".")
            out.add((own, int(m[1]), owner.replace("/", ".") or own, rest, name.partition(":")[2]))
    return out


def test_calls_are_those_of_javap(compiled, tmp_path):
    files = sorted(compiled.glob("*.class"))
    jar = next(Path(pyspark.__file__).parent.glob("jars/RoaringBitmap-*.jar"))
    with zipfile.ZipFile(jar) as z:
        for name in [n for n in z.namelist() if n.endswith(".class")][:60]:
            target = tmp_path / name.replace("/", "_")
            target.write_bytes(z.read(name))
            files.append(target)
    rows = [r for f in files for r in class_files.class_rows(str(f), f.read_bytes())]
    assert not [r for r in rows if r.get("problem")]
    found = {(r["class"], r["at"], r["owner"], r["name"], r["type"]) for r in rows if r["kind"] in ("virtual", "special", "static", "interface")}
    told = listed(files)
    assert len(told) > 800
    assert found == told


def of(rows: list[dict], method: str) -> tuple[list[dict], dict[str, int]]:
    mine = [r for r in rows if r.get("method") == method]
    return mine, {r["name"]: r["dst"] for r in mine if r["kind"] == "parameter"}


def test_values_along_the_stack(compiled):
    rows = list(class_files.class_rows("Sample", (compiled / "Sample.class").read_bytes()))
    values = lambda r: [a["value"] for a in r["args"]]
    mine, given = of(rows, "choose")
    (back,) = (values(r)[0] for r in mine if r["kind"] == "return")
    assert {values(r)[0] for r in mine if r["kind"] == "phi" and r["dst"] == back} == {given["1"], given["2"]}
    mine, given = of(rows, "same")
    assert [values(r) for r in mine if r["kind"] == "return"] == [[given["1"]]] and not [r for r in mine if r["kind"] == "phi"]
    mine, given = of(rows, "loop")
    (back,) = (values(r)[0] for r in mine if r["kind"] == "return")
    meets = {values(r)[0] for r in mine if r["kind"] == "phi" and r["dst"] == back}
    sums = {r["dst"]: values(r) for r in mine if r["kind"] == "binary"}
    assert given["1"] in meets and len(meets) == 2 and back in sums[(meets - {given["1"]}).pop()]
    mine, given = of(rows, "guarded")
    caught = {r["dst"]: r["type"] for r in mine if r["kind"] == "catch"}
    assert sorted(map(str, caught.values())) == ["None", "java.lang.IllegalStateException"]
    (back,) = (values(r)[0] for r in mine if r["kind"] == "return")
    ends = {values(r)[0] for r in mine if r["kind"] == "phi" and r["dst"] == back}
    assert {r["name"] for r in mine if r.get("dst") in ends} == {"trim", "getMessage"}
    assert next(r["line"] for r in mine if r.get("name") == "trim") == 1 + JAVA[: JAVA.index("r = s.trim")].count("\n")
    mine, _ = of(rows, "lambdas")
    assert {"Sample.lambda$lambdas$0", "Sample.<init>"} <= {r["owner"] for r in mine if r["kind"] == "dynamic"}
    assert len([r for r in of(rows, "wide")[0] if r["kind"] == "store_index"]) == 3


def test_facts_of_compiled_code(spark, compiled):
    good = [(f.name, bytearray(f.read_bytes())) for f in sorted(compiled.glob("*.class"))]
    odd = [("text", bytearray(b"words")), ("none", None), ("", bytearray()), ("short", good[0][1][:100]), ("twice", good[1][1]), ("bad", bytearray(struct.pack(">IHHH", 0xCAFEBABE, 0, 61, 2) + b"\x63"))]
    rows = class_files.decoded(spark.createDataFrame(good + odd, "path string, content binary")).cache()
    problems = {r.path: r.problem for r in rows.where("kind = 'problem'").collect()}
    assert set(problems) == {"short", "bad"}
    assert class_files.decoded(spark.createDataFrame([], "path string, content binary")).count() == 0
    rows = rows.where("path <> 'twice'")
    assert {(r["class"], r.method) for r in class_files.natives(rows).collect()} == {("Base", "outside")}
    above = {(r.sub, r.super) for r in calls.closure(class_files.supertypes(rows)).collect()}
    assert ("Base", "java.lang.Comparable") in above and ("Sample", "java.lang.Object") in above
    met = {(r.callee, r.kind, r.arity) for r in class_files.calls(rows).where("func like 'Sample.lists%'").collect()}
    assert {("java.util.ArrayList", "special", 0), ("java.util.ArrayList.set", "virtual", 2), ("java.util.Map.put", "interface", 2), ("Sample.sink", "static", 1)} <= met
    reads, exact = containers.replayed(*class_files.collection_facts(rows))
    lists = "func like 'Sample.lists%'"
    given = {r.name: r.dst for r in rows.where("method = 'lists' and kind = 'parameter'").collect()}
    got = [r.element for r in reads.where(lists).orderBy("pos").collect()]
    bad, clean = given["0"], given["1"]
    assert got == [clean, clean, bad, clean, bad]  # set() gives what was there, then two of the list and two of the map
    assert exact.where(lists).count() == 9
    assert exact.where("func like 'Sample.escapes%'").count() == 0


METHODS = [("add", 1), ("addFirst", 1), ("add", 2), ("set", 2), ("get", 1), ("remove", 1), ("peek", 0), ("getLast", 0), ("pop", 0), ("pollLast", 0), ("size", 0), ("clear", 0)]
MAP_METHODS = [("put", 2), ("putIfAbsent", 2), ("get", 1), ("getOrDefault", 2), ("remove", 1), ("containsKey", 1), ("clear", 0)]


def brute(kind: str, calls_: list[tuple]) -> list | None:
    """Elements that calls give, with Python's own list and dict; None if a call writes beyond the end."""
    held, out = ([] if kind == "list" else {}), []
    for name, key, element in calls_:
        gives = None
        if name == "clear":
            held.clear()
        elif kind == "map":
            if name == "put":
                gives, held[key] = held.get(key), element
            elif name == "putIfAbsent":
                gives = held.get(key)
                held.setdefault(key, element)
            elif name in ("get", "getOrDefault"):
                gives = held.get(key, element if name == "getOrDefault" else None)
            elif name == "remove":
                gives = held.pop(key, None)
        elif name == "add" and key is None:
            held.append(element)
        elif name == "addFirst":
            held.insert(0, element)
        elif name in ("add", "set"):
            if key > len(held) - (name == "set"):
                return None
            if name == "set":
                gives, held[key] = held[key], element
            else:
                held.insert(key, element)
        elif name in ("get", "remove"):
            gives = held[key] if key < len(held) else None
            if name == "remove" and key < len(held):
                del held[key]
        elif held and name in ("peek", "getLast"):
            gives = held[0 if name == "peek" else -1]
        elif held and name in ("pop", "pollLast"):
            gives = held.pop(0 if name == "pop" else -1)
        out.append(gives)
    return out


def test_collections_against_brute_force(spark):
    rng = random.Random(5)
    makers, uses, copies, expected = [], [], [], {}
    for f in range(120):
        kind = rng.choice(["list", "map"])
        fault = rng.choice([None] * 6 + ["escape", "block", "unknown", "method", "copied", "early", "twice"])
        makers.append((f, 0, 10, 0, "java.util.Vector" if kind == "list" else "java.util.TreeMap", [(50, None, False)] if fault == "copied" else rng.choice([[], [(51, "16", True)]])))
        copies += [(f, 1, 0), (f, 2, 1)]
        if fault == "twice":
            makers.append((f, 0, 11, 2, "java.util.Vector", []))
        done = []
        for k in range(rng.randrange(1, 25)):
            name, n = rng.choice((METHODS[:2] * 3 + METHODS) if kind == "list" else MAP_METHODS)
            element = 1000 + k
            keyed = kind == "map" and n or n == 2 or name in ("get", "remove")
            key = (rng.randrange(4) if kind == "list" else rng.choice("abc")) if keyed else None
            args = ([(99, str(key), kind == "list")] if keyed else []) + ([(element, None, False)] if n == 2 or n == 1 and not keyed else [])
            done.append((name, key, element if n == 2 or not keyed else None))
            uses.append((f, 0, 20 + k, rng.randrange(3), "receiver", name, args, 2000 + k))
        last = (f, 0, 90, 1, "receiver", "size", [], None)
        if fault:
            uses.append({"escape": (f, 0, 90, 2, "other", None, [], None), "block": (f, 7, 90, 1, "receiver", "size", [], None), "unknown": (f, 0, 90, 1, "receiver", "get", [(99, None, True)], 5), "method": (f, 0, 90, 1, "receiver", "iterator", [], 5), "early": (f, 0, 5, 1, "receiver", "size", [], 5)}.get(fault, last))
        got = None if fault else brute(kind, done)
        expected[f] = {20 + k: g for k, g in enumerate(got)} if got is not None else {}
    uses += [(None, 0, 1, 0, "receiver", "get", [], 1), (3, 0, None, 77, None, None, None, None)]
    args = containers.ARGS
    m = spark.createDataFrame(makers, f"func int, block int, pos int, value long, type string, args {args}")
    u = spark.createDataFrame(uses, f"func int, block int, pos int, value long, role string, method string, args {args}, result long")
    c = spark.createDataFrame(copies, "func int, dst long, src long")
    reads, exact = containers.replayed(m, u, c)
    got = defaultdict(dict)
    for r in exact.join(reads, ["func", "pos"], "left").collect():
        got[r.func][r.pos] = r.element
    assert {f: v for f, v in expected.items() if v} == dict(got)
    assert sum(map(bool, expected.values())) > 30
    general = spark.createDataFrame([(f, 20, 7, 8) for f in range(120)], "func int, pos int, src long, dst long")
    kept = containers.refined(general, reads, exact)
    assert kept.where("src = 7").count() == sum(not v for v in expected.values())
    assert all(df.count() == 0 for df in containers.replayed(m.limit(0), u.limit(0), c.limit(0)))


def test_receiver_labels_against_brute_force(spark):
    rng = random.Random(8)
    calls_, rules, expected = [], [], set()
    held = defaultdict(set)
    for pos in range(300):
        on, to = rng.choice([*range(6), None]), rng.choice([None, None, *range(6), 50 + pos])
        calls_.append((pos, pos, on, to))
        mine = [(pos, k, rng.choice([None, [], ["a"], ["b", "c"]]), rng.choice([None, ["a"], ["c"], ["d", "d"]])) for k in range(rng.choice([0, 0, 1, 2]))]
        rules += mine
        if on is None:
            continue
        expected |= {(pos, label) for label in held[on]}
        for _, _, remove, add in mine:
            held[on] = held[on] - set(remove or ()) | set(add or ())
        if to is not None:
            held[to] |= held[on]
    c = spark.createDataFrame(calls_, "call int, pos int, object int, result int")
    t = spark.createDataFrame(rules, "call int, nth int, remove array<string>, add array<string>")
    assert {tuple(r) for r in receiver_labels.labels_at_calls(c, t).collect()} == expected and len(expected) > 200
    assert receiver_labels.labels_at_calls(c.limit(0), t.limit(0)).count() == 0
    chain = spark.createDataFrame([(k, k, k, k + 1) for k in range(6)], c.schema)
    one = spark.createDataFrame([(0, 0, None, ["x"])], t.schema)
    assert receiver_labels.labels_at_calls(chain, one).count() == 5
    with pytest.raises(NotFinished):
        receiver_labels.labels_at_calls(chain, one, rounds=3)


def test_nodes_of_rules_on_odd_rows(spark):
    rules = spark.createDataFrame([("r", None, None, None, None, "^s", True)], "rule_id string, language string, kind string, on_load boolean, on_store boolean, base_regex string, direct_only boolean")
    accesses = spark.createDataFrame([(1, "go", "s", 7, False, None), (2, None, None, 7, False, None), (3, "go", "s", 7, True, None), (4, "go", "s", 7, False, "0"), (5, "go", "as", 7, False, None), (1, "go", "s", 7, False, None)], "access int, language string, base_name string, index int, is_load boolean, constant string")
    assert [tuple(r) for r in flow.index_sinks(accesses, rules).collect()] == [("sink:1:r:index", "value:7", "r", "generic")] * 2
    assert flow.index_sinks(accesses.limit(0), rules).count() == flow.index_sinks(accesses, rules.limit(0)).count() == 0
    functions = spark.createDataFrame([(1, 0, False), (2, 1, True), (3, 3, True), (4, None, None)], "function int, params int, receiver boolean")
    ports = spark.createDataFrame([("r", "args_from0", None), ("r", "receiver", "k"), ("r", "arg5", "k"), ("r", "named:x", "k")], "rule_id string, port string, kind string")
    matches = functions.selectExpr("function", "'r' as rule_id")
    found = {(r.node, r.port) for r in flow.function_nodes(matches, functions, ports, "sink").collect()}
    assert found == {("sink:2:r:receiver", "formal:2:0"), ("sink:3:r:receiver", "formal:3:0"), ("sink:3:r:arg0", "formal:3:1"), ("sink:3:r:arg1", "formal:3:2")}


WEB = """
import java.util.*;

interface Reader { String read(String name); }

class Plain implements Reader {
    public String read(String name) { return System.getenv(name); }
}

class Fixed implements Reader {
    public String read(String name) { return "fixed"; }
}

class Web {
    static String kept;
    String own;

    static void direct() throws Exception {
        String v = System.getenv("A");
        Runtime.getRuntime().exec(v.trim() + "x");
    }

    static void called(Reader r) throws Exception {
        run(r.read("B"));
        run("no");
    }

    static void run(String c) throws Exception {
        Runtime.getRuntime().exec(c);
    }

    static String same(String s) { return s; }

    static void returned() throws Exception {
        String a = same(System.getenv("C"));
        String b = same("clean");
        Runtime.getRuntime().exec(b);
        Runtime.getRuntime().exec(a);
    }

    static void lists() throws Exception {
        ArrayList<String> l = new ArrayList<>();
        l.add("clean");
        l.add(System.getenv("D"));
        Runtime.getRuntime().exec(l.get(0));
        Runtime.getRuntime().exec(l.get(1));
    }

    void fields() throws Exception {
        own = System.getenv("E");
        String[] all = new String[2];
        all[0] = own;
        new ProcessBuilder(all).start();
        StringBuilder text = new StringBuilder();
        text.append(clean(own));
        Runtime.getRuntime().exec(text.toString());
    }

    static String clean(String s) { return s; }
}
"""


def test_class_files_to_findings(spark, tmp_path):
    if not shutil.which("javac") or not shutil.which("jar"):
        pytest.skip("needs a Java compiler")
    (tmp_path / "Web.java").write_text(WEB)
    subprocess.run(["javac", "-g", "-nowarn", "-d", str(tmp_path / "out"), str(tmp_path / "Web.java")], check=True, capture_output=True)
    subprocess.run(["jar", "cf", str(tmp_path / "web.jar"), "-C", str(tmp_path / "out"), "."], check=True, capture_output=True)
    jar = (tmp_path / "web.jar").read_bytes()
    files = archives.extract(spark.createDataFrame([("web.jar", bytearray(jar)), ("copy.jar", bytearray(jar))], "path string, content binary"))
    kind = lambda rules: matching.rules_frame(spark, rules).withColumn("kind", F.lit("cmd"))
    sources = kind([("env", "java", Matcher(exact="java.lang.System.getenv", arg_types=["java.lang.String"]))])
    sinks = kind([("exec", "java", Matcher(method_name="exec", receiver_type="java.lang.Runtime")), ("make", None, Matcher(exact="java.lang.ProcessBuilder"))])
    line = lambda text: 1 + WEB[: WEB.index(text)].count("\n")
    wanted = {line(t) for t in ("Runtime.getRuntime().exec(v", "Runtime.getRuntime().exec(c)", "Runtime.getRuntime().exec(a)", "Runtime.getRuntime().exec(l.get(1))", "new ProcessBuilder(all)", "Runtime.getRuntime().exec(text")}
    cleaner = kind([("clean", "java", Matcher(exact="Web.clean"))])
    found = class_scan.scan(files, sources, sinks, cleaner).collect()
    assert {r.location for r in found} == {f"copy.jar!/Web.class:{n}" for n in wanted - {line("Runtime.getRuntime().exec(text")}}
    types = spark.createDataFrame([("(I[[Ljava/util/List;J[B)V",), ("()I",), (None,)], "d string").select(class_scan.java_types(F.col("d")).alias("t")).collect()
    assert [r.t for r in types] == [["int", "java.util.List[][]", "long", "byte[]"], [], None]


def test_thread_flows(spark):
    found = spark.createDataFrame([("s", "k", "a", "b", 1, 3, "x.py:7", [1, 2, 3], "complete"), ("s", "k", "a", "b", 1, 9, "dir:y.py:8", [1, 9], "context_limit"), ("***", "***", "l", "l", 0, 0, "@analysis", [], "visit_limit")], "source_rule_id string, sink_rule_id string, source_kind string, sink_kind string, source_node long, sink_node long, location string, path array<long>, completeness string")
    places = spark.createDataFrame([(1, "x.py", 0, None), (2, "x.py", 4, "mid"), (3, "x.py", 7, "end")], "node long, uri string, line int, label string")
    out = {r.sink_node: json.loads(r.value) for r in reports.taint_results(found, places).collect()}
    lines = lambda r: [s["location"]["physicalLocation"]["region"]["startLine"] for s in r["codeFlows"][0]["threadFlows"][0]["locations"]]
    assert lines(out[3]) == [1, 4, 7] and lines(out[9]) == [1] and lines(out[0]) == []
    assert out[9]["locations"][0]["physicalLocation"] == {"artifactLocation": {"uri": "dir:y.py"}, "region": {"startLine": 8}}
    assert len(out[3]["relatedLocations"]) == 1 and out[0]["relatedLocations"] == [] and not out[9]["properties"]["analysisComplete"]
    assert reports.taint_results(found.limit(0), places.limit(0)).count() == 0
