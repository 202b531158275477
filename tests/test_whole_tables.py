"""Queries over whole tables, against brute force."""

from collections import defaultdict

import pytest

from factloom.operators import graph
from factloom.plans import conformance, conformance_more


@pytest.fixture
def hops(spark, tmp_path, monkeypatch):
    """Events whose hops make several components, in stretches of four ids of which some lack a type; and their pairs."""
    monkeypatch.setattr(conformance_more, "STRETCH", 4)
    said = {"view": [900, 2, 900, 3, 50, 3, 50, 7], "error": [7, 8, 60, 8], "signup": [50], "click": [70, 1, 70, 70], None: [8, 90]}
    rows, at = [], 0
    for k in range(8):
        for kind, users in said.items():
            if k < len(users):
                rows.append((at, users[k], kind, float(k)))
            at += 3
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path), {(a, b) for users in said.values() for a, b in zip(users, users[1:])}


def closure(pairs):
    found = defaultdict(set)
    for node in {n for p in pairs for n in p}:
        queue = [node]
        while queue:
            at = queue.pop()
            for a, b in pairs:
                if a == at and b not in found[node]:
                    found[node].add(b)
                    queue.append(b)
    return found


def test_all_hops_and_their_components(spark, hops):
    d, pairs = hops
    to = closure(pairs)
    want = {(n, max([n, *(m for m in to[n] if n in to[m])])) for n in {n for p in pairs for n in p}}
    assert len({r for _, r in want}) > 3 and any(b < a - 40 for a, b in pairs)
    edges = conformance_more.all_hops(spark, d)
    assert {tuple(r) for r in edges.collect()} == pairs
    for found in (conformance_more.strong_components(spark, d), graph.strong_components(edges, 0)):
        assert {(r.node, r.root) for r in found.collect()} == want

    root, depth, layer = dict(want), {}, {dict(want)[50]}
    for k in range(4):
        depth |= {r: k for r in layer - set(depth)}
        layer = {root[b] for a, b in pairs if root[a] in layer}
    assert {(r.node, r.depth) for r in conformance_more.reach_condensed(spark, d).collect()} == {(n, depth[r]) for n, r in want if r in depth}


def test_all_events_make_hops(spark, sf):
    users = {r.user_id for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().collect()}
    assert {r.node for r in conformance_more.strong_components(spark, sf).collect()} == users


def merged(lines):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for order, part in lines:
        parent[find(("part", part))] = find(("order", order))
    first = {}
    for order in sorted({o for o, _ in lines}):
        first.setdefault(find(("order", order)), order)
    return {(o, first[find(("order", o))]) for o, _ in lines}


def test_all_lines_merge_orders(spark, sf, tmp_path):
    """Several components on a fixture, and the table's own giant one."""
    lines = [(1, 10), (2, 10), (2, 11), (5, 11), (3, 12), (9, 12), (9, 13), (4, 14), (0, 0), (7, 0), (8, 1)]
    spark.createDataFrame([(o, p, 7.0, "N") for o, p in lines], "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = lambda d: {(r.node, r.root) for r in conformance.components_alias_merge(spark, d).collect()}
    assert got(str(tmp_path)) == merged(lines) and len({r for _, r in merged(lines)}) == 5
    assert got(sf) == merged([tuple(r) for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()])


SF = "/root/testdata/sf0.01"  # the smaller one has no sink


@pytest.mark.parametrize("name", ["reach_bounded", "taint_reach_pairs", "shortest_dep_path", "propagate_facts"])
def test_walks_start_from_every_customer(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    sql = conformance.ORACLES[f"{name}_all"]
    assert "c_mktsegment" not in sql and "c_nationkey =" not in sql
    want = {tuple(r) for r in con.sql(sql).fetchall()}
    got = conformance.QUERIES[f"{name}_all"](spark, SF).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 0
    assert want != {tuple(r) for r in con.sql(conformance.ORACLES[name]).fetchall()}


def test_witnesses_start_from_every_customer(spark):
    sources, sinks = conformance_more.everyone(spark, SF), conformance.trade_ends(spark, SF)[1]
    reached, _ = graph.reach(conformance.trade_edges(spark, SF), sources, 3, probe=False)
    want = {r.node for r in reached.join(sinks, "node").collect()}
    assert {r.location for r in conformance.QUERIES["witness_findings_all"](spark, SF).collect()} == want
