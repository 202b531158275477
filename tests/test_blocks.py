"""Control flow: lowering of all statement kinds, single assignment, constants, loops, against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from factloom.operators import dataflow, ssa
from factloom.sources import python_code

EVERYTHING = '''
import os as system, sys

async def everything(a, *more, key=None, **rest):
    global g
    x: int = 1
    y: str
    x += 2
    a.b, (c, *d) = more
    a[0] += 1
    for i, j in more:
        if i:
            continue
        elif j is None:
            break
        x = x + 1
    else:
        x = 7
    while x < 10 and (k := a()) or c:
        try:
            x = a.read()
            if x == 3:
                return x
            break
        except (ValueError, TypeError) as e:
            raise RuntimeError from e
        except OSError:
            continue
        else:
            d = -x
        finally:
            a.close()
    with a as f, open(key):
        with f:
            return [u * 2 for v in f if v for u in v] or {n: {m} for n in d for m in n}
    match a:
        case [1, first, *others] if first:
            x = others
        case {"k": value, **left}:
            x = left
        case _:
            pass
    assert x, "no x"
    del x
    def inner(z):
        nonlocal c
        return z + c
    class Local(Exception):
        pass
    async for t in a:
        await t
    async with a:
        yield t
    try:
        import json
    except* OSError:
        raise
    return inner(lambda q: q + i) if key else not f"{a!r:>{key}}"

def empty(): ...

def only_raise(v):
    try:
        try:
            v.first()
        finally:
            v.last()
    except:
        return v
    raise v
'''


def lowered(spark, text):
    insts, cfg = python_code.lower(spark.createDataFrame([(3, "a.py", text)], "file_id long, path string, content string"))
    return ssa.code_of(insts, cfg), insts, cfg


def test_all_statements_lower_to_single_assignment(spark):
    code, insts, cfg = lowered(spark, EVERYTHING)
    assert dataflow.validate(insts, cfg).where("problem = 'duplicate_value'").count() > 0
    again = ssa.to_ssa(code).cache()
    assert again.select("func_id").distinct().count() == 4
    new_insts, new_cfg, phis = ssa.parts_of(again)
    assert dataflow.validate(new_insts, new_cfg, phis).collect() == []
    assert phis.count() > 10
    ways = {(r.func_id, r.src, r.dst) for r in new_cfg.collect()}
    assert all((r.func_id, r.pred, r.block) in ways for r in phis.collect())
    assert dataflow.nullness(new_insts, new_cfg).count() > 0


def test_finally_runs_on_every_way_out(spark):
    code, insts, _ = lowered(spark, "def f(a):\n    while a:\n        try:\n            if a.x():\n                return 1\n            if a.y():\n                break\n            a.z()\n        finally:\n            a.close()\n    return 2\n")
    assert insts.where("op = 'close'").count() == 4  # return, break, the end, an exception
    rows = code.where("what = 'edge'").collect()
    leads = defaultdict(set)
    for r in rows:
        leads[r.block].add(r.to)
    closing = {r.block for r in insts.where("op = 'close'").collect()}
    ends = {r.block for r in insts.where("kind in ('return', 'raise')").collect()}
    begun = {r.block for r in insts.where("op = 'x'").collect()}
    seen, todo = set(), list(begun)
    while todo:  # no end is reached from within but through a closing block
        b = todo.pop()
        if b not in seen and b not in closing:
            seen.add(b)
            todo += leads[b]
    assert not seen & ends


def random_code(rng, n):
    """Blocks with steps on three slots and branches on them."""
    insts, cfg = [], []
    for b in range(n):
        for pos in range(rng.randint(0, 3)):
            kind = rng.choice(["const", "add", "copy", "multiply", "negate", "call"])
            insts.append((1, b, pos, kind, rng.randint(0, 2), None if kind in ("const", "call") else rng.randint(0, 2), None, rng.choice([0, 1, 2, (1 << 62) + 1, -5]) if kind in ("const", "add", "multiply") else None))
        insts.append((1, b, 9, "nop", None, None, None, None))
        what = rng.random()
        to = [rng.randrange(n), rng.randrange(n)]
        if what < 0.4:
            v, bound = rng.randint(0, 2), rng.choice([0, 1, 3])
            kind = rng.choice(["lt", "eq"])
            cfg += [(1, b, to[0], kind, v, True, bound), (1, b, to[1], kind, v, False, bound)]
        elif what < 0.9:
            cfg += [(1, b, t, "goto", None, None, None) for t in to[: rng.randint(1, 2)]]
    return insts, cfg


def table_of(spark, many):
    insts = [(k, *r[1:]) for k, (i, _) in enumerate(many) for r in i]
    cfg = [(k, *r[1:]) for k, (_, c) in enumerate(many) for r in c]
    return ssa.code_of(spark.createDataFrame(insts, dataflow.INST_DDL), spark.createDataFrame(cfg, dataflow.CFG_DDL))


def run(rows, rng, steps=60):
    """One random way through code: (blocks gone through, [(kind of instruction, its place, what it read, what it wrote)])."""
    insts, edges, phis = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        {"inst": insts, "edge": edges, "phi": phis}[r.what][r.block].append(r)
    env, b, pred, seen, wrote = {}, min([*insts, *edges]), None, [], {}
    calls = 0
    for _ in range(steps):
        seen.append(b)
        env |= {r.dst: env.get(r.src, "?") for r in phis[b] if r.to == pred}
        for r in phis[b]:
            if r.to == pred:
                wrote.setdefault(r.dst, set()).add(env[r.dst])
        for r in sorted(insts[b], key=lambda r: r.pos):
            if r.dst is None:
                continue
            a = env.get(r.src, "?")
            if r.kind == "const":
                env[r.dst] = ssa.wrapped(r.const)
            elif r.kind in ssa.ARITHMETIC:
                env[r.dst] = "?" if a == "?" else ssa.wrapped(ssa.ARITHMETIC[r.kind](a, r.const or 0))
            else:
                env[r.dst] = "?"
                calls += 1
            wrote.setdefault(r.dst, set()).add(env[r.dst])
        ways = [e for e in edges[b] if e.kind == "goto" or env.get(e.src, "?") == "?" or ((env[e.src] < e.const) if e.kind == "lt" else (env[e.src] == e.const)) == e.sense]
        if not ways:
            break
        pred, b = b, rng.choice(sorted(e.to for e in ways))
    return seen, wrote, env


def test_single_assignment_and_constants_against_runs(spark):
    rng = random.Random(4)
    many = [random_code(rng, rng.randint(1, 7)) for _ in range(120)]
    code = table_of(spark, many)
    again = ssa.to_ssa(code).cache()
    consts, less = defaultdict(dict), defaultdict(list)
    for r in ssa.constants(again).collect():
        consts[r.func_id][r.value] = r.const
    for r in ssa.folded(again).collect():
        less[r.func_id].append(r)
    before, after = defaultdict(list), defaultdict(list)
    for r in code.collect():
        before[r.func_id].append(r)
    for r in again.collect():
        after[r.func_id].append(r)
    found = big = dead = 0
    for k in before:
        defs = [r.dst for r in after[k] if r.what == "inst" and r.dst is not None] + list({r.dst for r in after[k] if r.what == "phi"})
        assert len(defs) == len(set(defs))
        kept = {r.block for r in less[k] if r.what == "inst"}
        dead += len({r.block for r in after[k] if r.what == "inst"} - kept)
        for seed in range(8):
            a, b = run(before[k], random.Random(seed)), run(after[k], random.Random(seed))
            assert a[0] == b[0]  # the same way through the same blocks
            assert set(b[0]) <= kept
            assert run(less[k], random.Random(seed))[0] == b[0]
            for v, c in consts[k].items():
                assert b[1].get(v, {c}) == {c}
                found += v in b[1]
                big += abs(c) > 1 << 61 and v in b[1]
    assert found > 200 and big > 10 and dead > 3


def test_places_of_phis_and_loops_against_their_definition(spark):
    rng = random.Random(6)
    many = [random_code(rng, rng.randint(2, 8)) for _ in range(80)]
    code = table_of(spark, many)
    places, loops = defaultdict(set), defaultdict(lambda: defaultdict(set))
    for r in ssa.phi_places(code).collect():
        places[r.func_id].add((r.block, r.value))
    for r in ssa.natural_loops(code).collect():
        loops[r.func_id][r.head].add(r.block)
    n_places = n_loops = 0
    for k, (insts, cfg) in enumerate(many):
        after = defaultdict(set)
        for _, a, b, *_ in cfg:
            after[a].add(b)
        first = min([r[1] for r in insts] + [a for _, a, *_ in cfg])

        def reach(start, without=()):
            seen, todo = set(), [s for s in start if s not in without]
            while todo:
                b = todo.pop()
                if b not in seen:
                    seen.add(b)
                    todo += [x for x in after[b] if x not in without]
            return seen

        live = reach([first])
        dom = lambda a, b: b not in reach([first], {a})
        want = defaultdict(set)
        for a in live:
            for h in after[a]:
                if dom(h, a):
                    want[h] |= {h} | {b for b in live if a in reach([b], {h})}
        assert loops[k] == want
        n_loops += len(want)
        # a value meets where two ways, apart until there, bring different definitions, and is read later
        writes = {b: {r[4] for r in insts if r[1] == b and r[4] is not None} for b in live}
        ordered = lambda b: sorted((r for r in insts if r[1] == b), key=lambda r: r[2])
        reads = {}
        for b in live:
            own, seen = set(), set()
            for r in ordered(b):
                own |= {r[5]} - seen - {None}
                seen |= {r[4]} - {None}
            reads[b] = own | {c for _, a, _, _, c, *_ in cfg if a == b and c is not None} - seen
        alive = lambda v, b: any(v in reads[x] for x in reach([b], {y for y in live if v in writes[y] and v not in reads[y] and y != b})) and (v in reads[b] or v not in writes[b])
        df = lambda x: {y for y in live if any(p in live and y in after[p] and dom(x, p) for p in live) and not (dom(x, y) and x != y)}
        for v in (0, 1, 2):
            got, todo = set(), [b for b in live if v in writes[b]]
            while todo:
                for y in df(todo.pop()):
                    if y not in got and alive(v, y):
                        got.add(y)
                        todo.append(y)
            assert {b for b, x in places[k] if x == v} == got, (k, v)
            n_places += len(got)
    assert n_places > 40 and n_loops > 40


def test_dead_branches_are_gone(spark):
    code, _, _ = lowered(spark, "def f(a):\n    n = 3\n    m = n + 4\n    if m < 5:\n        a.never()\n    else:\n        n = 9\n    while n < 3:\n        a.nor_this()\n    if n == 9:\n        a.yes()\n    return m * 2\n")
    less = ssa.folded(ssa.to_ssa(code))
    assert {r.op for r in less.where("op is not null").collect()} == {"a", "yes"}
    insts, cfg, phis = ssa.parts_of(less)
    assert dataflow.validate(insts, cfg, phis).collect() == [] and cfg.where("kind <> 'goto'").count() == 0


def test_loop_sinks(spark):
    code, _, _ = lowered(spark, "def f(a, n):\n    i = 0\n    while i < 10:\n        i += 1\n        if n < 5:\n            a.x()\n        if n == 8:\n            break\n    if n < 3:\n        pass\n")
    again = ssa.to_ssa(code)
    got = {(r.kind, r.bound, r.inside) for r in ssa.loop_sinks(again).collect()}
    assert got == {("lt", 10, True), ("eq", 8, False)}
    assert again.where(F.col("what") == "phi").count() > 0
