"""Per-function analyses on instruction rows: nullness, integer ranges, lifetimes.

insts(func_id, block, pos, kind, dst, src, op, const): kinds const, null, copy, call, deref, index, alloc, free, move, add,
assume. cfg_edges(func_id, src, dst, kind, cond_value, cond_sense): the branch edge on which a value is known to be
non-null (kind "null", sense true: null) or below a bound (kind "lt"). One function is a group; functions are
independent, so the analyses run in parallel over all of them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship

INST_DDL = "func_id long, block int, pos int, kind string, dst int, src int, op string, const long"
CFG_DDL = "func_id long, src int, dst int, kind string, cond_value int, cond_sense boolean, bound long"
#: The eleven lifetime states; joining two different ones that aren't bottom loses certainty.
LIFETIMES = ("bottom", "uninitialised", "owned", "borrowed", "moved", "freed", "maybe_moved", "maybe_freed", "escaped", "null", "unknown")


def _grouped(insts: DataFrame, cfg: DataFrame, analyse, schema: str) -> DataFrame:
    ship(insts.sparkSession)
    named = cfg.select(*(F.col(c).alias(f"edge_{c}") for c in cfg.columns))  # the two may come from one table, whose columns would be taken for one another

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.rename(columns=lambda c: c.removeprefix("edge_"))
        blocks: dict[int, list] = {}
        for r in a.sort_values(["block", "pos"]).itertuples():
            whole = lambda v: None if pd.isna(v) else int(v)
            blocks.setdefault(int(r.block), []).append((int(r.pos), r.kind, whole(r.dst), whole(r.src), r.op, whole(r.const)))
        edges: dict[int, list] = {}
        for r in b.itertuples():
            edges.setdefault(int(r.src), []).append((int(r.dst), r.kind, None if pd.isna(r.cond_value) else int(r.cond_value), r.cond_sense, None if pd.isna(r.bound) else int(r.bound)))
        rows = list(analyse(blocks, edges))
        return pd.DataFrame([(key[0] if key else None, *r) for r in rows], columns=[c.split()[0] for c in schema.split(", ")])

    return insts.groupBy("func_id").cogroup(named.groupBy("edge_func_id")).applyInPandas(run, schema)


def worklist(blocks: dict, edges: dict, entry: dict, step, refine, join, widen_after: int = 8):
    """Facts before each instruction: (block, pos, facts). step(facts, inst), refine(facts, edge), join(a, b, widen)."""
    first = min(blocks, default=None)
    if first is None:
        return
    known, queue, rounds = {first: dict(entry)}, [first], {}
    while queue:
        b = queue.pop(0)
        facts = dict(known[b])
        for inst in blocks.get(b, ()):
            step(facts, inst)
        for edge in edges.get(b, ()):
            out = refine(dict(facts), edge)
            if out is None:
                continue
            to = edge[0]
            rounds[to] = rounds.get(to, 0) + 1
            new = out if to not in known else {v: join(known[to].get(v), out.get(v), to <= b and rounds[to] > widen_after) for v in known[to].keys() | out.keys()}
            if to not in known or new != known[to]:
                known[to] = new
                if to not in queue:
                    queue.append(to)
    for b in sorted(known):
        facts = dict(known[b])
        for inst in blocks.get(b, ()):
            yield b, inst, dict(facts)
            step(facts, inst)


def _null_step(facts: dict, inst: tuple) -> None:
    _, kind, dst, src, _, _ = inst
    if dst is not None:
        facts[dst] = {"null": "null", "alloc": "nonnull", "const": "nonnull"}.get(kind, facts.get(src, "unknown") if kind in ("copy", "move") else "unknown")
    if kind in ("deref", "index") and src is not None:
        facts[src] = "nonnull"


def _null_refine(facts: dict, edge: tuple):
    _, kind, value, sense, _ = edge
    if kind == "null" and value is not None:
        want = "null" if sense else "nonnull"
        if facts.get(value) not in (None, "unknown", want):
            return None  # the branch can't be taken
        facts[value] = want
    return facts


def nullness(insts: DataFrame, cfg: DataFrame) -> DataFrame:
    """(func_id, block, pos, value, fact): what is known of the value that an instruction dereferences."""

    def run(blocks, edges):
        for b, (pos, kind, _, src, _, _), facts in worklist(blocks, edges, {}, _null_step, _null_refine, lambda a, c, w: a if a == c else "unknown"):
            if kind in ("deref", "index") and src is not None:
                yield b, pos, src, facts.get(src, "unknown")

    return _grouped(insts, cfg, run, "func_id long, block int, pos int, value int, fact string")


_INF = float("inf")


def _range_step(facts: dict, inst: tuple) -> None:
    _, kind, dst, src, _, const = inst
    if dst is None:
        return
    if kind == "const":
        facts[dst] = (const, const)
    elif kind in ("copy", "move"):
        facts[dst] = facts.get(src, (-_INF, _INF))
    elif kind == "add":
        lo, hi = facts.get(src, (-_INF, _INF))
        facts[dst] = (lo + const, hi + const)
    else:
        facts[dst] = (-_INF, _INF)


def _range_refine(facts: dict, edge: tuple):
    _, kind, value, sense, bound = edge
    if kind == "lt" and value is not None:
        lo, hi = facts.get(value, (-_INF, _INF))
        lo, hi = (lo, min(hi, bound - 1)) if sense else (max(lo, bound), hi)
        if lo > hi:
            return None
        facts[value] = (lo, hi)
    return facts


def _range_join(a, b, widen):
    a, b = a or (-_INF, _INF), b or (-_INF, _INF)
    if widen:
        return (a[0] if b[0] >= a[0] else -_INF, a[1] if b[1] <= a[1] else _INF)
    return min(a[0], b[0]), max(a[1], b[1])


def index_safety(insts: DataFrame, cfg: DataFrame) -> DataFrame:
    """(func_id, block, pos, value, verdict): whether an index (value src, array length const) is safe, out of bounds or
    unknown, by the interval of its value."""

    def run(blocks, edges):
        for b, (pos, kind, _, src, _, length), facts in worklist(blocks, edges, {}, _range_step, _range_refine, _range_join):
            if kind == "index" and src is not None and length is not None:
                lo, hi = facts.get(src, (-_INF, _INF))
                yield b, pos, src, "safe" if lo >= 0 and hi < length else "out_of_bounds" if hi < 0 or lo >= length else "unknown"

    return _grouped(insts, cfg, run, "func_id long, block int, pos int, value int, verdict string")


def join_lifetimes(a: str | None, b: str | None) -> str:
    a, b = a or "bottom", b or "bottom"
    if a == b or b == "bottom":
        return a
    if a == "bottom":
        return b
    both = {a, b}
    return "maybe_freed" if both & {"freed", "maybe_freed"} else "maybe_moved" if both & {"moved", "maybe_moved"} else "unknown"


def _life_step(facts: dict, inst: tuple) -> None:
    _, kind, dst, src, _, _ = inst
    if kind == "free" and src is not None:
        facts[src] = "freed"
    elif kind == "move" and src is not None:
        facts[src] = "moved"
        if dst is not None:
            facts[dst] = "owned"
    elif dst is not None:
        facts[dst] = {"alloc": "owned", "null": "null", "copy": "borrowed"}.get(kind, "unknown")


def lifetimes(insts: DataFrame, cfg: DataFrame) -> DataFrame:
    """(func_id, block, pos, value, problem): uses after free or move, double frees, certain or possible."""
    names = {"freed": "use_after_free", "maybe_freed": "possible_use_after_free", "moved": "use_after_move", "maybe_moved": "possible_use_after_move"}

    def run(blocks, edges):
        for b, (pos, kind, _, src, _, _), facts in worklist(blocks, edges, {}, _life_step, lambda f, e: f, lambda a, c, w: join_lifetimes(a, c)):
            state = facts.get(src) if src is not None else None
            if kind == "free" and state in ("freed", "maybe_freed"):
                yield b, pos, src, "double_free" if state == "freed" else "possible_double_free"
            elif kind in ("deref", "index", "call", "copy") and state in names:
                yield b, pos, src, names[state]

    return _grouped(insts, cfg, run, "func_id long, block int, pos int, value int, problem string")


def validate(insts: DataFrame, cfg: DataFrame, phis: DataFrame | None = None) -> DataFrame:
    """(func_id, problem): functions to leave out: a place or value defined twice, a use without a definition, a jump to a
    block that isn't there. phis(func_id, block, dst, src, pred), a row for each way in, define values as well."""
    if phis is not None:
        none = lambda t: F.lit(None).cast(t)
        made = phis.select("func_id", "block", "dst").distinct().select("func_id", "block", none("int").alias("pos"), F.lit("phi").alias("kind"), "dst", none("int").alias("src"), none("string").alias("op"), none("long").alias("const"))
        read = phis.select("func_id", "block", none("int").alias("pos"), F.lit("phi").alias("kind"), none("int").alias("dst"), "src", none("string").alias("op"), none("long").alias("const"))
        insts = insts.unionByName(made).unionByName(read)
    places = insts.where("pos is not null").groupBy("func_id", "block", "pos").count().where("count > 1").select("func_id", F.lit("duplicate_instruction").alias("problem"))
    values = insts.where("dst is not null").groupBy("func_id", "dst").count().where("count > 1").select("func_id", F.lit("duplicate_value").alias("problem"))
    defined = insts.where("dst is not null").select("func_id", F.col("dst").alias("src")).distinct()
    uses = insts.where("src is not null").join(defined, ["func_id", "src"], "left_anti").select("func_id", F.lit("undefined_value").alias("problem"))
    blocks = insts.select("func_id", F.col("block").alias("dst")).distinct()
    jumps = cfg.join(blocks, ["func_id", "dst"], "left_anti").select("func_id", F.lit("missing_block").alias("problem"))
    return places.unionByName(values).unionByName(uses).unionByName(jumps).distinct()
