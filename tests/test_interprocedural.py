"""Heap congruence, bridged cells, returned parts, and flow through calls, against enumeration."""

import random
from collections import defaultdict

import pytest

from factloom.operators import congruence, interprocedural
from factloom.operators.congruence import NotFinished
from factloom.operators.interprocedural import Program


def merged(equal, cells):
    """Classes by naive union until nothing changes."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    def join(a, b):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
            return True
        return False

    for a, b in equal:
        join(a, b)
    changed = True
    while changed:
        changed, seen = False, {}
        for base, field, value in cells:
            find(base)
            changed |= join(seen.setdefault((find(base), field), value), value)
    first = defaultdict(list)
    for x in list(parent):
        first[find(x)].append(x)
    return {x: min(xs) for xs in first.values() for x in xs}


def random_heap(rng, n=30):
    equal = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 6))]
    cells = [(rng.randrange(n), rng.choice("fgh"), rng.randrange(n)) for _ in range(rng.randint(5, 30))]
    return equal, cells


def test_congruence_is_the_smallest(spark):
    rng = random.Random(2)
    deep = 0
    for k in range(6):
        equal, cells = random_heap(rng)
        if k == 0:  # two lists whose heads are one: they merge all the way down
            equal, cells = [(0, 100)], [(i, "next", i + 1) for i in range(9)] + [(100 + i, "next", 101 + i) for i in range(12)]
        got = congruence.closure(spark.createDataFrame(equal, "src long, dst long"), spark.createDataFrame(cells, "base long, field string, value long"))
        got = {r.node: r.root for r in got.collect()}
        assert got == merged(equal, cells)
        deep += sum(got[x] != x for x in got)
    assert deep > 20
    with pytest.raises(NotFinished):
        congruence.closure(spark.createDataFrame([(0, 100)], "src long, dst long"), spark.createDataFrame([(i, "n", i + 1) for i in range(9)] + [(100 + i, "n", 101 + i) for i in range(9)], "base long, field string, value long"), rounds=2)


def test_alias_roots_merge_choices_that_agree(spark):
    copies = spark.createDataFrame([(1, 2, 1), (1, 3, 1), (1, 11, 10), (2, 2, 5)], "func long, dst long, src long")
    merges = spark.createDataFrame([(1, 4, 2), (1, 4, 3), (1, 6, 2), (1, 6, 10), (1, 7, 4), (1, 7, 1), (1, 8, 8), (1, 8, 20), (2, 3, 2), (2, 3, 5)], "func long, dst long, src long")
    got = {(r.func, r.value): r.root for r in congruence.alias_roots(copies, merges).collect()}
    assert got == {(1, 1): 1, (1, 2): 1, (1, 3): 1, (1, 4): 1, (1, 7): 1, (1, 6): 6, (1, 10): 10, (1, 11): 10, (1, 8): 8, (1, 20): 20, (2, 2): 2, (2, 5): 2, (2, 3): 2}
    cells = spark.createDataFrame([(1, 1, "f", 30), (1, 3, "f", 31), (1, 30, "g", 2), (1, 31, "g", 10)], "func long, base long, field string, value long")
    with_cells = {(r.func, r.value): r.root for r in congruence.alias_roots(copies, merges, cells).collect()}
    assert with_cells[1, 31] == with_cells[1, 30] == 30 and with_cells[1, 6] == with_cells[1, 10] == 1


def test_object_identity(spark):
    rows = [
        (1, 0, "new", 1, None, "f1:a"), (1, 1, "new", 2, None, "f1:b"), (1, 2, "copy", 3, 1, None), (1, 3, "merge", 4, 1, None), (1, 3, "merge", 4, 3, None), (1, 4, "merge", 5, 1, None),
        (1, 4, "merge", 5, 2, None), (1, 5, "merge", 6, 9, None), (1, 5, "merge", 6, 2, None), (1, 6, "merge", 7, 1, None), (1, 6, "merge", 7, 8, None), (1, 7, "copy", 8, 7, None), (2, 0, "copy", 1, 5, None),
    ]
    got = {(r.func, r.value): (r.root, r.site) for r in congruence.object_identity(spark.createDataFrame(rows, "func long, pos long, kind string, dst long, src long, site string")).collect()}
    assert got == {(1, 1): (1, "f1:a"), (1, 2): (2, "f1:b"), (1, 3): (1, "f1:a"), (1, 4): (1, "f1:a"), (1, 6): (2, "f1:b"), (1, 7): (1, "f1:a"), (1, 8): (1, "f1:a")}


def test_cells_are_bridged_at_calls(spark):
    """caller: x.a is p, p.b is q. callee(y): reads y.a.b. Another function isn't called."""
    cells = [(1, 10, "a", 11), (1, 11, "b", 12), (2, 20, "a", 21), (2, 21, "b", 22), (3, 30, "a", 31)]
    classes, links = congruence.bridged(spark.createDataFrame([(1, 10, 2, 20)], "func long, value long, to_func long, to_value long"), spark.createDataFrame(cells, "func long, base long, field string, value long"))
    assert {tuple(r) for r in links.collect()} == {(1, 11, 2, 21, "a"), (1, 12, 2, 22, "b")}
    root = {(r.func, r.value): (r.root_func, r.root_value) for r in classes.collect()}
    assert root[2, 22] == root[1, 12] == (1, 12) and root[3, 31] == (3, 31)


def test_what_functions_return_of_their_parameters(spark):
    """f(p): return p.a.b; g(x, y): return x if .. else y.c; loop(p): while ..: p = p.next; return p."""
    params = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (2, 1, 2), (3, 0, 1)], "func long, nth int, value long")
    copies = spark.createDataFrame([(2, 4, 1), (2, 4, 3), (3, 2, 1), (3, 2, 3)], "func long, dst long, src long")
    loads = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "b", 3), (2, 2, "c", 3), (3, 2, "next", 3)], "func long, base long, field string, value long")
    returns = spark.createDataFrame([(1, 3), (2, 4), (3, 2)], "func long, value long")
    found = congruence.returned_projections(params, copies, loads, returns, depth=3)
    assert {(r.func, r.nth, ".".join(r.steps)) for r in found.collect()} == {(1, 0, "a.b"), (2, 0, ""), (2, 1, "c"), (3, 0, ""), (3, 0, "next"), (3, 0, "next.next"), (3, 0, "next.next.next")}
    calls = spark.createDataFrame([(100, 9, 1, 50), (101, 9, 2, 51), (102, 9, 1, 52)], "call long, func long, callee long, result long")
    actuals = spark.createDataFrame([(100, 0, 40), (101, 0, 40), (101, 1, 41), (102, 0, 44)], "call long, nth int, value long")
    cells = spark.createDataFrame([(9, 42, "a", 43), (9, 43, "b", 45)], "func long, base long, field string, value long")
    roots = spark.createDataFrame([(9, 40, 40), (9, 42, 40)], "func long, value long, root long")
    got = {tuple(r) for r in congruence.returned_cells(found.where("func < 3"), calls, actuals, cells, roots).collect()}
    assert got == {(100, 50, 9, 43, "b"), (101, 51, 9, 40, None), (101, 51, 9, 41, "c")}


def test_object_shapes(spark):
    cells = spark.createDataFrame([(1, 1, "a", 2), (1, 2, "b", 3), (1, 1, "c", 3), (1, 3, "up", 1), (1, 3, "d", 4), (1, 4, "e", 5), (1, 5, "f", 6)], "func long, base long, field string, value long")
    found, more = congruence.object_shapes(cells.withColumnRenamed("x", "y"), spark.createDataFrame([(1, 1), (1, 6)], "func long, root long"), depth=3)
    assert {(r.root, r.node, r.shape, r.steps) for r in found.collect()} == {(1, 1, "", 0), (6, 6, "", 0), (1, 2, "a", 1), (1, 3, "c", 1), (1, 4, "c.d", 2), (1, 5, "c.d.e", 3)}
    assert {tuple(r) for r in more.collect()} == {(1, 1)}


# --- calls -------------------------------------------------------------------------------------------------------------


def random_program(rng, funcs=5, nodes=4):
    at = lambda f, k: f * 100 + k
    local = [(f, at(f, rng.randrange(nodes)), at(f, rng.randrange(nodes))) for f in range(funcs) for _ in range(rng.randint(1, 4))]
    params = [(f, n, at(f, n)) for f in range(funcs) for n in range(2)]
    returns = [(f, at(f, nodes - 1)) for f in range(funcs)]
    calls, actuals = [], []
    for c in range(rng.randint(3, 9)):
        f, g = rng.randrange(funcs), rng.randrange(funcs)
        calls.append((1000 + c, f, g, at(f, rng.randrange(nodes)) if rng.random() < 0.9 else None))
        actuals += [(1000 + c, n, at(f, rng.randrange(nodes))) for n in range(2) if rng.random() < 0.8]
    return local, calls, actuals, params, returns


def frames(spark, program):
    ddl = ("func long, src long, dst long", "call long, func long, callee long, result long", "call long, nth int, node long", "func long, nth int, node long", "func long, node long")
    return [spark.createDataFrame(rows, d) for rows, d in zip(program, ddl, strict=True)]


def moves(program):
    """(node, next, push, pop) of every move."""
    local, calls, actuals, params, returns = program
    out = [(a, b, None, None) for _, a, b in local]
    for c, _, g, result in calls:
        out += [(node, p, c, None) for k, n, node in actuals if k == c for f, m, p in params if f == g and m == n]
        out += [(node, result, None, c) for f, node in returns if f == g and result is not None]
    return out


def ways(program, starts, deepest):
    """States (node, stack) by enumeration, stacks of at most `deepest` sites; deeper ones are left out."""
    steps = defaultdict(list)
    for a, b, push, pop in moves(program):
        steps[a].append((b, push, pop))
    seen, todo = set(), [(s, ()) for s in starts]
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        node, stack = at
        for b, push, pop in steps[node]:
            if push is not None and len(stack) < deepest:
                todo.append((b, (*stack, push)))
            elif pop is not None and (not stack or stack[-1] == pop):
                todo.append((b, stack[:-1]))
            elif push is None and pop is None:
                todo.append((b, stack))
    return seen


@pytest.mark.parametrize("seed", range(2))
def test_matched_reachability_against_enumeration(spark, seed):
    rng = random.Random(seed)
    rows = random_program(rng)
    program = Program(*frames(spark, rows))
    known, edges = interprocedural.summaries(program)
    want = set()
    for f, n, p in rows[3]:  # a parameter reaches a return of its function, at the depth where it began
        inner = ways(rows, [p], 7)
        own_level = {node for node, stack in ways_from_entry(rows, p, 7) if not stack}
        if any(node in own_level for g, node in rows[4] if g == f):
            want.add((f, n))
        assert own_level <= {node for node, _ in inner}
    assert {tuple(r) for r in known.collect()} == want
    sites = {(c, f, node, result) for c, f, g, result in rows[1] for k, n, node in rows[2] if k == c and (g, n) in want and result is not None}
    assert {(r.call, r.func, r.src, r.dst) for r in edges.collect()} == sites

    start = rows[0][0][1]
    exact = ways(rows, [start], 7)
    got = {r.node: r.entered for r in interprocedural.reach_matched(program, spark.createDataFrame([(start,)], "node long"), edges).collect()}
    assert set(got) == {n for n, _ in exact} and {n for n, e in got.items() if not e} == {n for n, s in exact if not s}
    for k in (0, 1, 2):
        states = interprocedural.reach_in_strings(program, spark.createDataFrame([(start,)], "node long"), k).collect()
        assert {n for n, _ in exact} <= {r.node for r in states}
        assert {(n, s) for n, s in ways(rows, [start], k)} <= {(r.node, tuple(r.stack)) for r in states}


def ways_from_entry(program, start, deepest):
    """Like ways(), but what began doesn't return."""
    steps = defaultdict(list)
    for a, b, push, pop in moves(program):
        steps[a].append((b, push, pop))
    seen, todo = set(), [(start, ())]
    while todo:
        at = todo.pop()
        if at in seen:
            continue
        seen.add(at)
        node, stack = at
        for b, push, pop in steps[node]:
            if push is not None and len(stack) < deepest:
                todo.append((b, (*stack, push)))
            elif pop is not None and stack and stack[-1] == pop:
                todo.append((b, stack[:-1]))
            elif push is None and pop is None:
                todo.append((b, stack))
    return seen


def test_returns_go_back_to_their_own_call(spark):
    """Two calls of the identity: what goes in at one doesn't come out at the other, but in strings of no sites it does."""
    rows = ([(1, 10, 11)], [(100, 2, 1, 21), (101, 3, 1, 31)], [(100, 0, 20), (101, 0, 30)], [(1, 0, 10)], [(1, 11)])
    program = Program(*frames(spark, rows))
    at = spark.createDataFrame([(20,)], "node long")
    assert {(r.node, r.entered) for r in interprocedural.reach_matched(program, at).collect()} == {(20, False), (21, False), (10, True), (11, True)}
    assert {r.node for r in interprocedural.reach_in_strings(program, at, 0).collect()} == {20, 10, 11, 21, 31}
    assert {(r.node, tuple(r.stack)) for r in interprocedural.reach_in_strings(program, at, 1).collect()} == {(20, ()), (10, (100,)), (11, (100,)), (21, ())}
    inside = interprocedural.reach_matched(program, spark.createDataFrame([(10,)], "node long"))
    assert {r.node for r in inside.where("not entered").collect()} == {10, 11, 21, 31}


def test_effects_of_what_is_called(spark):
    """set(o, v): o.f = v; wrap(v, o): set(o, v); both(x): wrap(x, x). free(p); drop(a, b): free(b)."""
    rows = ([], [(100, 2, 1, None), (101, 3, 2, None), (102, 5, 4, None)], [(100, 0, 201), (100, 1, 200), (101, 0, 300), (101, 1, 300), (102, 0, 501)], [(1, 0, 100), (1, 1, 101), (2, 0, 200), (2, 1, 201), (3, 0, 300), (4, 0, 400), (5, 0, 500), (5, 1, 501)], [])
    program = Program(*frames(spark, rows))
    found = interprocedural.heap_summaries(program, spark.createDataFrame([(1, 100, "f", 101)], "func long, base long, field string, value long"))
    assert {tuple(r) for r in found.select("func", "nth", "field", "from_nth").collect()} == {(1, 0, "f", 1), (2, 1, "f", 0), (3, 0, "f", 0)}
    contracts = interprocedural.lifetime_contracts(program, spark.createDataFrame([(4, 400, "frees")], "func long, node long, effect string"))
    assert {tuple(r) for r in contracts.collect()} == {(4, 0, "frees"), (5, 1, "frees")}
    calls = spark.createDataFrame([(7, 9, 5, 3)], "call long, func long, callee long, pos int")
    steps = interprocedural.contract_steps(contracts, calls, spark.createDataFrame([(7, 0, 90), (7, 1, 91)], "call long, nth int, node long"))
    assert [tuple(r) for r in steps.collect()] == [(9, 3, 91, "frees")]
