"""Control flow of functions: dominators, single assignment, constants that decide branches, natural loops.

Code is one table of rows (CODE_DDL): "inst" rows as in dataflow.INST_DDL, "edge" rows as in dataflow.CFG_DDL (from `block` to
`to`), and, once to_ssa has been at it, "phi" rows: `dst` is `src` where control comes from block `to`; a phi has a row for each
way in. A function is one group, its first block is its smallest; functions are independent and analysed in parallel.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship

CODE_DDL = "func_id long, what string, block int, pos int, kind string, dst int, src int, op string, const long, to int, sense boolean"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def code_of(insts: DataFrame, cfg: DataFrame) -> DataFrame:
    """Instructions and edges as one table. An edge's condition is on `src`, its bound is `const`."""
    none = lambda t: F.lit(None).cast(t)
    rows = insts.select("func_id", F.lit("inst").alias("what"), "block", "pos", "kind", "dst", "src", "op", "const", none("int").alias("to"), none("boolean").alias("sense"))
    edges = cfg.select("func_id", F.lit("edge").alias("what"), F.col("src").alias("block"), none("int").alias("pos"), "kind", none("int").alias("dst"), F.col("cond_value").alias("src"), none("string").alias("op"), F.col("bound").alias("const"), F.col("dst").alias("to"), F.col("cond_sense").alias("sense"))
    return rows.unionByName(edges)


def parts_of(code: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """insts, cfg as other analyses want them, and phis(func_id, block, dst, src, pred)."""
    insts = code.where("what = 'inst'").select("func_id", "block", "pos", "kind", "dst", "src", "op", "const")
    cfg = code.where("what = 'edge'").select("func_id", F.col("block").alias("src"), F.col("to").alias("dst"), "kind", F.col("src").alias("cond_value"), F.col("sense").alias("cond_sense"), F.col("const").alias("bound"))
    return insts, cfg, code.where("what = 'phi'").select("func_id", "block", "dst", "src", F.col("to").alias("pred"))


class Blocks:
    """The control flow of one function, what its entry reaches: order, dominators, frontiers, loops."""

    def __init__(self, edges: list[tuple[int, int]], entry: int):
        self.entry = entry
        after, self.before = defaultdict(list), defaultdict(list)
        for a, b in dict.fromkeys(edges):
            after[a].append(b)
        order, seen, work = [], {entry}, [(entry, iter(after[entry]))]
        while work:
            for b in work[-1][1]:
                if b not in seen:
                    seen.add(b)
                    work.append((b, iter(after[b])))
                    break
            else:
                order.append(work.pop()[0])
        self.order = order[::-1]
        self.after = {a: after[a] for a in self.order}
        for a in self.order:
            for b in self.after[a]:
                self.before[b].append(a)
        self.idom = self._dominators()

    def _dominators(self) -> dict[int, int]:
        """The nearest dominator of each block, by walking up from blocks' ways in until nothing changes."""
        nth = {b: i for i, b in enumerate(self.order)}
        idom = {self.entry: self.entry}
        changed = True
        while changed:
            changed = False
            for b in self.order[1:]:
                new = None
                for p in self.before[b]:
                    if p not in idom:
                        continue
                    other = p
                    while new is not None and new != other:
                        if nth[new] > nth[other]:
                            new = idom[new]
                        else:
                            other = idom[other]
                    new = other
                if idom.get(b) != new:
                    idom[b] = new
                    changed = True
        return idom

    def dominates(self, a: int, b: int) -> bool:
        while b != a and b != self.entry:
            b = self.idom[b]
        return a == b

    def frontiers(self) -> dict[int, set[int]]:
        """Where each block's dominance ends: blocks that it doesn't strictly dominate, but a way in of theirs."""
        out = defaultdict(set)
        for b in self.order:
            for p in self.before[b]:
                while p != self.idom[b] or b == self.entry:
                    out[p].add(b)
                    if p == self.entry:
                        break
                    p = self.idom[p]
        return out

    def loops(self) -> dict[int, set[int]]:
        """Head -> blocks of its natural loop: what reaches an edge back to a dominator without passing that one."""
        out: dict[int, set[int]] = {}
        for a in self.order:
            for head in self.after[a]:
                if self.dominates(head, a):
                    body = out.setdefault(head, {head})
                    todo = [a]
                    while todo:
                        b = todo.pop()
                        if b not in body:
                            body.add(b)
                            todo += self.before[b]
        return out


class Function:
    """One function's rows, taken apart."""

    def __init__(self, rows: list[dict]):
        self.id = rows[0]["func_id"]
        self.insts: dict[int, list[list]] = defaultdict(list)
        self.edges: list[list] = []
        self.phis: dict[tuple[int, int], list[tuple[int | None, int]]] = defaultdict(list)
        whole = lambda v: -1 if v is None else v
        for r in sorted(rows, key=lambda r: (r["block"], *(whole(r[c]) for c in ("pos", "to", "src")))):
            if r["what"] == "inst":
                self.insts[r["block"]].append([r[c] for c in ("pos", "kind", "dst", "src", "op", "const")])
            elif r["what"] == "edge":
                self.edges.append([r[c] for c in ("block", "to", "kind", "src", "sense", "const")])
            else:
                self.phis[r["block"], r["dst"]].append((r["src"], r["to"]))
        places = [*self.insts, *(e[0] for e in self.edges), *(e[1] for e in self.edges)]
        self.flow = Blocks([(e[0], e[1]) for e in self.edges], min(places))


def _grouped(code: DataFrame, analyse, ddl: str) -> DataFrame:
    ship(code.sparkSession)
    schema = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])

    def run(rows: pa.Table) -> pa.Table:
        own = Function(rows.to_pylist())
        found = [(own.id, *r) for r in analyse(own)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)] if found else [pa.array([], f.type) for f in schema], schema=schema)

    return code.groupBy("func_id").applyInArrow(run, ddl)


def _phi_places(own: Function) -> dict[int, set[int]]:
    """Block -> values that meet there: on the frontiers of their definitions, again of these, and alive."""
    flow, frontiers = own.flow, own.flow.frontiers()
    defined: dict[int, set[int]] = defaultdict(set)
    wants: dict[int, set[int]] = defaultdict(set)  # values that a block reads before it writes them
    writes: dict[int, set[int]] = defaultdict(set)
    for b in flow.order:
        for _, _, dst, src, _, _ in own.insts.get(b, ()):
            if src is not None and src not in writes[b]:
                wants[b].add(src)
            if dst is not None:
                writes[b].add(dst)
                defined[dst].add(b)
    for a, _, _, value, _, _ in own.edges:
        if value is not None and value not in writes[a]:
            wants[a].add(value)
    alive = {b: set(wants[b]) for b in flow.order}
    todo = list(flow.order)
    while todo:
        b = todo.pop()
        for p in flow.before[b]:
            new = alive[b] - writes[p] - alive[p]
            if new:
                alive[p] |= new
                todo.append(p)
    out: dict[int, set[int]] = defaultdict(set)
    for v, blocks in defined.items():
        todo = list(blocks)
        while todo:
            for b in frontiers.get(todo.pop(), ()):
                if v in alive[b] and v not in out[b]:
                    out[b].add(v)
                    todo.append(b)
    return out


def phi_places(code: DataFrame) -> DataFrame:
    """(func_id, block, value): where different definitions of a value meet and it is read later."""
    return _grouped(code, lambda own: [(b, v) for b, vs in _phi_places(own).items() for v in vs], "func_id long, block int, value int")


def _renamed(own: Function) -> Iterator[tuple]:
    flow, places = own.flow, _phi_places(own)
    children = defaultdict(list)
    for b in flow.order[1:]:
        children[flow.idom[b]].append(b)
    counter = 0
    undefined: dict[int, int] = {}

    def fresh() -> int:
        nonlocal counter
        counter += 1
        return counter

    phi_dst = {(b, v): fresh() for b in flow.order for v in sorted(places.get(b, ()))}
    phi_src: list[tuple[int, int, int, int]] = []
    out_edges = defaultdict(list)
    for e in own.edges:
        out_edges[e[0]].append(e)
    rows: list[tuple] = []

    def name(env: dict[int, int], v: int) -> int:
        if v not in env and v not in undefined:
            undefined[v] = fresh()
        return env.get(v) or undefined[v]

    work = [(flow.entry, {})]
    while work:  # down the dominator tree; what a block knows is what its dominator ends with
        b, env = work.pop()
        env = dict(env)
        for v in places.get(b, ()):
            env[v] = phi_dst[b, v]
        for pos, kind, dst, src, op, const in own.insts.get(b, ()):
            src = None if src is None else name(env, src)
            if dst is not None:
                env[dst] = fresh()
            rows.append(("inst", b, pos, kind, None if dst is None else env[dst], src, op, const, None, None))
        for _, to, kind, value, sense, bound in out_edges[b]:
            rows.append(("edge", b, None, kind, None, None if value is None else name(env, value), None, bound, to, sense))
        for to in flow.after[b]:
            for v in places.get(to, ()):
                phi_src.append((to, phi_dst[to, v], name(env, v), b))
        work += [(c, env) for c in children[b]]
    for k, v in enumerate(sorted(undefined)):  # read where nothing was written
        rows.append(("inst", flow.entry, -1 - k, "undefined", undefined[v], None, None, None, None, None))
    rows += [("phi", b, None, "phi", dst, src, None, None, pred, None) for b, dst, src, pred in phi_src]
    yield from rows


def to_ssa(code: DataFrame) -> DataFrame:
    """The code with every value written once: definitions renamed, phis where they meet, blocks that nothing leads to left
    out. What is read before it is written is one "undefined" instruction at the entry."""
    return _grouped(code, _renamed, CODE_DDL)


# --- constants ---------------------------------------------------------------------------------------------------------
_VARYING = object()


def wrapped(n: int) -> int:
    """n as a 64-bit integer that overflows."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


ARITHMETIC = {"add": lambda a, c: a + c, "multiply": lambda a, c: a * c, "negate": lambda a, c: -a, "copy": lambda a, c: a, "move": lambda a, c: a}


def _taken(kind: str, value, sense: bool | None, bound: int | None) -> bool:
    """Whether control may go along an edge, of whose condition's value this is known (None: nothing yet)."""
    if kind not in ("lt", "eq") or value is _VARYING or bound is None or sense is None:
        return True
    return value is not None and (value < bound if kind == "lt" else value == bound) == sense


def _constants(own: Function) -> tuple[dict[int, object], set[int]]:
    """Values known to be one number on all ways that can be gone, and the blocks on these ways: both grow together, as a
    branch that is decided keeps its other side's definitions away from the phis."""
    known: dict[int, object] = {}
    reached, ways = {own.flow.entry}, set()
    by_block = defaultdict(list)
    for (b, dst), inputs in own.phis.items():
        by_block[b].append((dst, inputs))
    changed = True

    def learn(dst: int, new) -> None:
        nonlocal changed
        old = known.get(dst)
        if new is None or old is _VARYING or old is not None and new == old and new is not _VARYING:
            return
        known[dst] = new if old is None else _VARYING
        changed = True

    for dst, _ in by_block[own.flow.entry]:  # a loop back to the entry: the first time nothing is written yet
        learn(dst, _VARYING)
    while changed:
        changed = False
        for b in [x for x in own.flow.order if x in reached]:
            for dst, inputs in by_block[b]:
                for src, pred in inputs:
                    if (pred, b) in ways:
                        learn(dst, known.get(src))
            for _, kind, dst, src, _, const in own.insts.get(b, ()):
                if dst is None:
                    continue
                if kind == "const":
                    learn(dst, wrapped(const) if const is not None else _VARYING)
                elif kind in ARITHMETIC:
                    a = known.get(src)
                    learn(dst, a if a is None or a is _VARYING else wrapped(ARITHMETIC[kind](a, const or 0)))
                else:
                    learn(dst, _VARYING)
            for a, to, kind, value, sense, bound in own.edges:
                if a == b and (a, to) not in ways and _taken(kind, known.get(value, _VARYING if value is None else None), sense, bound):
                    ways.add((a, to))
                    reached.add(to)
                    changed = True
    return known, reached


def _decided(own: Function) -> list[tuple]:
    return [(v, c) for v, c in _constants(own)[0].items() if c is not _VARYING]


def constants(ssa: DataFrame) -> DataFrame:
    """(func_id, value, const) of values of to_ssa's code that are one number on every way that can be gone. Arithmetic is of 64
    bits and overflows."""
    return _grouped(ssa, _decided, "func_id long, value int, const long")


def _folded(own: Function) -> Iterator[tuple]:
    known, reached = _constants(own)
    number = lambda v: known.get(v) if isinstance(known.get(v), int) else None
    for b in own.flow.order:
        if b not in reached:
            continue
        for pos, kind, dst, src, op, const in own.insts.get(b, ()):
            c = number(dst)
            yield ("inst", b, pos, "const", dst, None, op, c, None, None) if c is not None and kind in ARITHMETIC else ("inst", b, pos, kind, dst, src, op, const, None, None)
    left = []
    for a, to, kind, value, sense, bound in own.edges:
        if a in reached and to in reached and _taken(kind, _VARYING if number(value) is None else number(value), sense, bound):
            left.append((a, to))
            decided = kind in ("lt", "eq") and number(value) is not None
            yield ("edge", a, None, "goto", None, None, None, None, to, None) if decided else ("edge", a, None, kind, None, value, None, bound, to, sense)
    for (b, dst), inputs in own.phis.items():
        if b in reached:
            for src, pred in inputs:
                if (pred, b) in left:
                    yield ("phi", b, None, "phi", dst, src, None, None, pred, None)


def folded(ssa: DataFrame) -> DataFrame:
    """The code without what can't be reached: branches that constants decide are plain jumps, and blocks behind the other
    side, with their ways into phis, are gone; arithmetic on constants is a constant."""
    return _grouped(ssa, _folded, CODE_DDL)


# --- loops -------------------------------------------------------------------------------------------------------------
def natural_loops(code: DataFrame) -> DataFrame:
    """(func_id, head, block): the blocks of each natural loop; loops with one head are one."""
    return _grouped(code, lambda own: [(h, b) for h, bs in own.flow.loops().items() for b in bs], "func_id long, head int, block int")


def _deciding(own: Function) -> Iterator[tuple]:
    out = defaultdict(list)
    for e in own.edges:
        out[e[0]].append(e)
    for head, body in own.flow.loops().items():
        made = {dst for b in body for _, _, dst, _, _, _ in own.insts.get(b, ()) if dst is not None} | {dst for (b, dst) in own.phis if b in body}
        for a in body:
            stays = {to in body for _, to, *_ in out[a]}
            if len(stays) == 2:
                yield from ((head, a, value, kind, bound, value in made) for _, _, kind, value, _, bound in out[a] if value is not None)


def loop_sinks(code: DataFrame) -> DataFrame:
    """(func_id, head, block, value, kind, bound, inside): the values that decide how often loops run: conditions of branches of
    which one side stays in the loop and one leaves it. inside: the loop makes the value itself."""
    return _grouped(code, _deciding, "func_id long, head int, block int, value int, kind string, bound long, inside boolean").distinct()
