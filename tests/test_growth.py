"""Steps that must not grow faster than their input, and results that must not depend on its size."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import advisories
from factloom.plans import conformance, conformance_more, conformance_ops  # noqa: F401  they register their queries


@pytest.fixture
def many(spark):
    """Forty dependencies of one version, one of another and one without, and thirty advisories with one range and one without."""
    rows = [("npm", "p", v, f"m{k}", k % 2 == 0) for k, v in enumerate(["1.5"] * 40 + ["9", None])]
    deps = spark.createDataFrame(rows, advisories.DEPENDENCY_DDL)
    known = [(f"CVE-{k}", None, "npm", "p", "high", "", None, ">=1, <2" if k else None, None, None, 0.1, False, None) for k in range(31)]
    return deps, spark.createDataFrame(known, advisories.ADVISORY_DDL)


def test_versions_are_judged_once_for_all_that_have_them(many, monkeypatch):
    real = advisories.judge
    told = advisories.candidates(*many)
    assert told.count() == 42 * 31 and told.where("__j.hit").count() == 40 * 30 and told.where("vulnerable_range is null and not __j.hit").count() == 42
    monkeypatch.setattr(advisories, "judge", lambda *a: F.struct(real(*a)["hit"].alias("hit"), real(*a)["known"].alias("known"), F.expr("uuid()").alias("fix")))
    judged = advisories.candidates(*many)
    assert judged.select("__j.fix").distinct().count() == 6  # three versions, two ranges
    assert advisories.candidates(*many, hits=True).count() == 1200


def test_findings_are_made_once_for_versions_in_the_same_ranges(many, monkeypatch):
    real = advisories.judge
    found = advisories.findings(*many).collect()
    assert len(found) == 40 * 30 and {(r.rule_id, r.manifest_path, r.direct) for r in found} == {(f"CVE-{k}", f"m{m}", m % 2 == 0) for k in range(1, 31) for m in range(40)}
    monkeypatch.setattr(advisories, "judge", lambda *a: F.struct(real(*a)["hit"].alias("hit"), real(*a)["known"].alias("known"), F.expr("uuid()").alias("fix")))
    assert advisories.findings(*many).select("fix").distinct().count() == 1


def test_warnings_read_a_version_without_its_advisories(many, monkeypatch):
    assert [(r.kind, r.package, r.n) for r in advisories.warnings(*many).collect()] == [("unresolved_version", "p", 31)]
    real, seen = advisories.judge, []
    monkeypatch.setattr(advisories, "judge", lambda *a: seen.append(a[-1]) or real(*a))
    advisories.warnings(*many)
    assert not any(isinstance(e, str) for e in seen)  # no range of an advisory is joined


def test_of_arguments_at_one_place_the_first_in_the_table_counts(spark, tmp_path):
    import duckdb

    parts = [7, 3, 9, 1, 8, 2, 6, 4]
    rows = [(k % 25, parts[(k // 25) % 8] + 100 * (k % 3), 1 + (k // 25) % 2, "R" if k % 5 else "N") for k in range(1000)]
    con = duckdb.connect()
    con.sql("set threads=1")  # with more, the SQL's own choice among equals varies
    values = conformance.values(rows)
    con.sql(f"copy (select * from (values {values}) t(l_orderkey, l_partkey, l_linenumber, l_returnflag)) to '{tmp_path}/lineitem.parquet'")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = {tuple(r) for r in con.sql(f"select how, formal, n, total from ({conformance.ORACLES['actual_formal_binding']})").fetchall()}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        assert {tuple(r) for r in conformance.QUERIES["actual_formal_binding"](spark, str(tmp_path)).select("how", "formal", "n", "total").collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    actuals = spark.createDataFrame([(1, 0, 1, None, v, at) for at, v in ((3, 30), (1, 10), (2, 20))], "call int, function int, place int, name string, value int, at int")
    formals = spark.createDataFrame([(0, 1, 1, "a", False, None)], "function int, formal int, place int, name string, rest boolean, default int")
    from factloom.operators import calls

    assert [r.value for r in calls.bind(actuals, formals, "at").collect()] == [10]


def test_witnesses_of_more_sinks_than_a_report_has_findings(spark, tmp_path):
    from factloom.operators import taint


    n = taint.FINDINGS + 10
    out = lambda rows, name: rows.write.parquet(f"{tmp_path}/{name}.parquet")
    out(spark.range(2).select(F.col("id").alias("c_custkey"), F.lit("BUILDING").alias("c_mktsegment")), "customer")
    out(spark.range(n).select(F.col("id").alias("s_suppkey")), "supplier")
    out(spark.range(2).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")), "orders")
    out(spark.range(n).select((F.col("id") % 2).alias("l_orderkey"), (F.col("id") % 2).alias("l_partkey"), F.col("id").alias("l_suppkey")), "lineitem")
    for name in ("witness_findings", "witness_findings_all"):
        found = conformance.QUERIES[name](spark, str(tmp_path))
        assert found.agg(F.count_distinct("location"), F.count("*"), F.max("completeness")).first()[:] == (n, n, "complete")


def test_what_starts_reach_is_not_written_as_pairs(spark, monkeypatch):
    from factloom.operators import graph

    rows = [(f"o{k}", "hub") for k in range(30)] + [("hub", f"s{k}") for k in range(40)] + [("o1", "s1"), ("o1", "s1"), ("s1", "o2"), ("o3", "o1"), ("s2", "s3"), (None, "s1"), ("o4", None)]
    to = {}
    for a, b in rows:
        if a and b:
            to.setdefault(a, set()).add(b)
    starts, targets = [f"o{k}" for k in range(30)] + ["s2", "x"], [f"s{k}" for k in range(40)] + ["o2", "s2", None]
    seen, real = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: (lambda out: seen.append(out.count()) or out)(real(df, name)))
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "node string")
    for depth in (0, 1, 2, 3):
        want = set()
        for s in starts:
            layer, done = {s}, set()
            for k in range(depth + 1):
                want |= {(s, t, k) for t in layer - done if t in targets}
                done |= layer
                layer = {b for a in layer for b in to.get(a, ())}
        seen.clear()
        got = [tuple(r) for r in graph.reaches(spark.createDataFrame(rows, "src string, dst string"), frame(starts), frame(targets), depth).collect()]
        assert set(got) == want and len(got) == len(want)
        assert depth != 2 or len(got) > 1200 > 300 > max(seen)


def test_plain_texts_are_searched_as_they_stand(spark, tmp_path):
    """An address isn't a comment, and white space isn't free before what a match must not hold."""
    import duckdb

    texts = ['see https://h.example token = "a1"', 'token = "ab" 0 left', 'secret = "0b"', '/* secret  =\n q7 */ x token = "c"', None, 'a\n"0 token = z\ntoken = z', "it's // token = k"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(f"select doc_id, line, match from ({conformance.ORACLES['search_patterns']})").fetchall())
    got = sorted(tuple(r) for r in conformance.QUERIES["search_patterns"](spark, str(tmp_path)).select("doc_id", "line", "match").collect())
    assert got == want and len(want) == 7


def _watched(monkeypatch, *modules):
    """(name, rows) of the tables that modules write from here on."""
    seen = []
    for m in modules:
        monkeypatch.setattr(m, "written", lambda df, name, real=m.written: (lambda out: seen.append((name, out.count())) or out)(real(df, name)))
    return seen


def test_what_a_cell_of_one_value_holds_is_not_carried_on(spark, monkeypatch):
    """Of 300 objects that are one by a star, each with three fields of one value: what is written is a few times the input."""
    from factloom.operators import congruence, graph

    bindings = spark.range(300).selectExpr("0L func", "-1000 - id value", "1L to_func", "0L to_value")
    cells = spark.range(300).selectExpr("0L func", "-1000 - id base", "explode(sequence(0, 2)) k", "id").selectExpr("func", "base", "'f' || k field", "id * 10 + k value")
    seen = _watched(monkeypatch, congruence, graph)
    classes, links = congruence.bridged(bindings, cells)
    assert sum(n for _, n in seen) < 8 * 1200 and links.count() == 0
    roots = {(r.func, r.value): (r.root_func, r.root_value) for r in classes.collect()}
    assert len(roots) == 1201 and roots[1, 0] == roots[0, -1000] == (0, -1299) and all(roots[0, 10 * i + k] == (0, k) for i in range(300) for k in range(3))


def test_merges_that_are_done_are_not_joined_again(spark, monkeypatch):
    """A chain of merges takes a round each; 2,000 copies beside it are looked at in the first round only."""
    from factloom.operators import congruence, graph

    copies = spark.createDataFrame([(0, 1, 0)] + [(1, k, 0) for k in range(1, 2001)], "func long, dst long, src long")
    merges = spark.createDataFrame([(0, k, k - d) for k in range(2, 9) for d in (1, 2)], "func long, dst long, src long")
    seen = _watched(monkeypatch, congruence, graph)
    got = {(r.func, r.value): r.root for r in congruence.alias_roots(copies, merges).collect()}
    assert got == {(0, k): 0 for k in range(9)} | {(1, k): 0 for k in range(2001)}
    assert sum(n for _, n in seen) < 5 * 2000


@pytest.fixture
def shuffled(spark):
    """A function that gives the rows shuffled since it was made; no join is a broadcast meanwhile."""
    store, key = spark.sparkContext._jsc.sc().statusStore(), "spark.sql.autoBroadcastJoinThreshold"

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (found.apply(k) for k in range(found.size()))}

    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    before = stages()
    yield lambda: sum(n for s, n in stages().items() if s not in before)
    spark.conf.set(key, old)


@pytest.fixture
def deep(spark):
    """Five functions that call one another in a row, each what it is given, and 2,000 others that call nobody."""
    from factloom.operators.interprocedural import Program

    frame = spark.createDataFrame
    funcs = list(range(5)) + list(range(100, 2100))
    local = frame([(4, 16, 19)] + [(f, 4 * f, 4 * f + 2) for f in funcs if f > 4], "func long, src long, dst long")
    calls = frame([(f, f, f + 1, 4 * f + 3) for f in range(4)], "call long, func long, callee long, result long")
    actuals = frame([(f, 0, 4 * f) for f in range(4)], "call long, nth int, node long")
    return Program(local, calls, actuals, frame([(f, 0, 4 * f) for f in funcs], "func long, nth int, node long"), frame([(f, 4 * f + 3) for f in funcs], "func long, node long"))


def test_call_strings_shuffle_what_is_new(spark, deep, shuffled):
    from factloom.operators import interprocedural

    starts = spark.createDataFrame([(0,)] + [(4 * f,) for f in range(100, 2100)], "node long")
    got = {(r.node, tuple(r.stack), r.cut) for r in interprocedural.reach_in_strings(deep, starts, 20).collect()}
    chain = {(4 * f, tuple(range(f)), False) for f in range(5)} | {(4 * f + 3, tuple(range(f)), False) for f in range(5)}
    assert got == chain | {(4 * f + k, (), False) for f in range(100, 2100) for k in (0, 2)}
    assert shuffled() < 10 * 2000


def test_call_summaries_shuffle_what_is_new(deep, shuffled):
    from factloom.operators import interprocedural

    known, edges = interprocedural.summaries(deep)
    assert sorted(map(tuple, known.collect())) == [(f, 0) for f in range(5)]
    assert sorted(map(tuple, edges.collect())) == [(f, 4 * f, 4 * f + 3, f) for f in range(4)]
    assert shuffled() < 10 * 2000


def test_paths_that_functions_return_shuffle_what_is_new(spark, shuffled):
    from factloom.operators import congruence

    frame = spark.createDataFrame
    params = frame([(f, 0, 0) for f in range(3000)], "func long, nth int, value long")
    copies = frame([(0, k + 1, k) for k in range(4)], "func long, dst long, src long")
    found = congruence.returned_projections(params, copies, frame([(0, 4, "a", 5)], "func long, base long, field string, value long"), frame([(0, 5)], "func long, value long"))
    assert [(r.func, r.nth, r.steps) for r in found.collect()] == [(0, 0, ["a"])]
    assert shuffled() < 4 * 3000


def test_facts_shuffle_what_is_new(spark, shuffled):
    from factloom.operators import graph

    seeds = spark.createDataFrame([(k, "a") for k in range(3000)], "node long, fact string")
    edges = spark.createDataFrame([(-k, -k - 1) for k in range(5)], "src long, dst long")
    assert {tuple(r) for r in graph.propagate(seeds, edges).collect()} == {(k, "a") for k in range(-5, 3000)}
    assert shuffled() < 4 * 3000


def test_long_texts_come_to_python_in_bounded_batches(spark):
    import pandas as pd

    from factloom.operators import text_rules

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pages = spark.range(300, numPartitions=1).select(F.lit("html").alias("language"), F.col("id").cast("string").alias("path"), F.concat(F.lit('<nav><a href="/x"></nav>'), F.repeat(F.lit("a"), 100_000)).alias("content"))
    assert text_rules.search(pages, ['href="/$WHERE'], inside=["<nav>...</nav>"]).count() == 300
    lot = F.pandas_udf(lambda t: pd.Series([len(t)] * len(t)), "long")  # rows of a batch, as an operator's own functions get them
    assert pages.select(lot("content").alias("n")).agg(F.max("n")).first()[0] < 60


def test_overlaps_have_as_many_tasks_as_their_pairs_need(spark, monkeypatch):
    from factloom.operators import heap

    rows = [(k % 7, k // 5) for k in range(60)] + [(k, 100) for k in range(40)] + [(None, 100), (3, None)]
    want = {}
    for a, x in set(rows):
        for b, y in set(rows):
            if x is not None and x == y and a is not None and b is not None and a < b:
                want[a, b] = want.get((a, b), 0) + 1
    frame = spark.createDataFrame(rows + rows, "cell int, object int")
    for lot in (4096, 6):
        if hasattr(heap, "LOT"):
            monkeypatch.setattr(heap, "LOT", lot)
        got = heap.overlaps(frame).collect()
        assert {(r.a, r.b): r.shared for r in got} == want and len(got) == len(want)
    many = spark.range(3 * 1500).select((F.col("id") % 1500).alias("cell"), (F.col("id") % 3).alias("object")).unionByName(spark.range(4500).select((F.col("id") % 1500).alias("cell"), F.floor(3 + F.col("id") / 1500).alias("object")))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        found = heap.overlaps(many).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(found) > 1 and sum(r.n for r in found) == 1500 * 1499 // 2


def test_who_calls_whom_is_not_told_apart_pair_by_pair(spark, tmp_path):
    import duckdb

    from factloom.operators import system_graph

    con = duckdb.connect()
    con.execute(f"copy (select range % 400 as user_id, range as event_id, case range % 7 when 0 then 'view' else 'buy' end as event_type, 1.0 as value from range(3000)) to '{tmp_path}/events.parquet'")
    con.execute(f"copy (select range as s_suppkey from range(90)) to '{tmp_path}/supplier.parquet'")
    for name in ("events", "supplier"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    found = conformance.QUERIES["route_join"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.select("client", "service").collect()) == sorted(con.sql(conformance.ORACLES["route_join"]).fetchall())
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    h = spark.createDataFrame([("s", "get", "/u/{id}/"), ("s", "POST", "/u"), ("t", "GET", "/u"), ("s", None, "/u"), ("v", "GET", "/x")], "service string, method string, path string")
    q = spark.createDataFrame([("c", "GET", "http://s/u/:id"), ("c", "POST", "/u"), ("d", "get", "/u"), ("e", "get", "/none"), ("d", "GET", "/u/<a>"), ("d", None, "/u")], "client string, method string, path string")
    assert sorted(tuple(r) for r in system_graph.route_clients(h, q).collect()) == [("c", "s"), ("d", "s"), ("d", "t")]


def test_a_tree_is_parsed_once_for_all_rules(spark):
    from factloom.operators import text_rules

    trees = spark.createDataFrame([(1, "<a><b/><b/><c/></a>"), (2, "<a/>"), (3, None), (4, "<c><b x='1'/></c>")], "tree int, xml string")
    found = text_rules.xpath_matches(trees, [("b", "//b"), ("c", "/a/c"), ("x", "//b[@x='1'] | //c"), ("none", "//d")])
    assert sorted(tuple(r) for r in found.collect()) == [(1, "b", 2), (1, "c", 1), (1, "x", 1), (4, "b", 1), (4, "x", 2)]
    assert found.schema["n"].dataType.simpleString() == "int" and found._jdf.queryExecution().optimizedPlan().toString().count(".evaluate(") == 1
    assert [tuple(r) for r in text_rules.xpath_matches(trees, [("b", "//b[1]")]).collect()] == [(1, "b", 1), (4, "b", 1)]


def test_kinds_that_nothing_becomes_are_not_walked_from(spark, monkeypatch):
    from factloom.operators import graph, taint

    rows = [(f"f{k}", f"m{k % 3}") for k in range(500)] + [("f0", "m1"), ("x", None), (None, "d")] + [(f"m{k}", f"m{(k + 1) % 6}") for k in range(6)]
    ring = {f"m{k}" for k in range(6)}
    want = {(a, b) for a in ring for b in ring} | {(f"f{k}", b) for k in range(500) for b in ring | {f"f{k}"}} | {("x", "x"), ("d", "d"), ("x", None)}
    seen, real = [], graph.written
    count = lambda df, name: (lambda out: seen.append(out.count()) or out)(real(df, name))
    monkeypatch.setattr(graph, "written", count)
    monkeypatch.setattr(taint, "written", count)
    got = [tuple(r) for r in taint.kind_closure(spark.createDataFrame(rows, "a string, b string")).collect()]
    assert set(got) == want and len(got) == len(want) and max(seen) < 1000


def test_walks_shuffle_what_is_new(spark, shuffled):
    from factloom.operators import graph

    edges = spark.range(3000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    one = lambda k: spark.createDataFrame([(k,)], "node long")
    assert sorted(tuple(r) for r in graph.slice_between(edges, one(5), one(9), 5).collect()) == [(k, k - 5, 9 - k) for k in range(5, 10)]
    assert sorted((r.node, r.depth, len(r.path)) for r in graph.shortest_paths(edges, one(5), 5).collect()) == [(k, k - 5, k - 4) for k in range(5, 11)]
    assert shuffled() < 3 * 3000


def test_effects_of_calls_use_the_paths_of_summaries(spark, deep, monkeypatch):
    from factloom.operators import interprocedural

    names, real = [], interprocedural.written
    monkeypatch.setattr(interprocedural, "written", lambda df, name: names.append(name) or real(df, name))
    found = interprocedural.heap_summaries(deep, spark.createDataFrame([(4, 16, "f", 19)], "func long, base long, field string, value long"))
    assert {tuple(r) for r in found.collect()} == {(f, 0, "f", 0) for f in range(5)}
    assert not names  # the path facts of summaries() are there and not found a second time


def test_matched_ways_shuffle_what_is_new(spark, deep, shuffled):
    from factloom.operators import interprocedural

    edges = spark.createDataFrame([(f, 4 * f, 4 * f + 3) for f in range(4)], "func long, src long, dst long")
    starts = spark.createDataFrame([(0,)] + [(4 * f,) for f in range(100, 2100)], "node long")
    got = {(r.node, r.entered) for r in interprocedural.reach_matched(deep, starts, edges).collect()}
    chain = {(0, False), (3, False)} | {(4 * f + k, True) for f in range(1, 5) for k in (0, 3)}
    assert got == chain | {(4 * f + k, False) for f in range(100, 2100) for k in (0, 2)}
    assert shuffled() < 30 * 2000


def test_what_starts_reach_moves_as_two_bytes_each(spark, monkeypatch):
    from factloom.operators import graph

    seen, real = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: seen.update({name: df.dtypes}) or real(df, name))
    edges = spark.range(70_000).select(F.lit("hub").alias("src"), F.concat(F.lit("s"), "id").alias("dst")).unionByName(spark.createDataFrame([("o1", "hub"), ("o2", "s69999")], "src string, dst string"))
    found = graph.reaches(edges, spark.createDataFrame([("o1",), ("o2",)], "node string"), spark.range(70_000).coalesce(1).select(F.concat(F.lit("s"), "id").alias("node")), 2)
    rows = found.groupBy("node").agg(F.count_distinct("target"), F.count("*"), F.min("steps"), F.max("steps")).collect()
    assert {tuple(r) for r in rows} == {("o1", 70_000, 70_000, 2, 2), ("o2", 1, 1, 1, 1)}
    assert ("places", "array<smallint>") in seen["lots"]


def test_the_last_level_of_shapes_is_not_written(spark, monkeypatch):
    from factloom.operators import congruence

    seen = _watched(monkeypatch, congruence)
    cells = spark.createDataFrame([(0, "o", "a", "p")] + [(0, "p", "b", f"t{k}") for k in range(50)], "func int, base string, field string, value string")
    found, more = congruence.object_shapes(cells, spark.createDataFrame([(0, "o")], "func int, root string"), depth=2)
    assert sorted((r.shape, r.steps) for r in found.collect()) == [("", 0), ("a", 1)] + [("a.b", 2)] * 50 and more.isEmpty()
    assert sum(n for name, n in seen if name == "shapes") == 2
