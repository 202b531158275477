"""JVM class files as instruction facts: constant pool, methods, and the operand stack followed to values.

A class file is a row and is decoded by itself, in Arrow batches; jars come in through archives.extract(). Values are
numbered within a method. Where ways meet, a local or stack slot is a value of its own with a 'phi' row for each of what it
may be, left out where that is only one. All that follows (calls, types, flows, collections) is selected from these rows.
"""

from __future__ import annotations

import struct
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.containers import ARGS
from factloom.session import ship

#: Larger class files are told and not read.
LIMIT = 32 << 20
#: Sizes of constants by tag (1 is text), of the operands of opcodes (none where not named).
POOL_SIZES = {3: 4, 4: 4, 5: 8, 6: 8, 7: 2, 8: 2, 9: 4, 10: 4, 11: 4, 12: 4, 15: 3, 16: 2, 17: 4, 18: 4, 19: 2, 20: 2}
OPERANDS = {16: 1, 17: 2, 18: 1, 19: 2, 20: 2, 132: 2, 169: 1, 185: 4, 186: 4, 187: 2, 188: 1, 189: 2, 192: 2, 193: 2, 197: 3, 198: 2, 199: 2, 200: 4, 201: 4}
OPERANDS |= dict.fromkeys([*range(21, 26), *range(54, 59)], 1) | dict.fromkeys([*range(153, 169), *range(178, 185)], 2)
#: Conversions to long and double; how many words dup forms copy, and below how many they put them.
WIDENING, DUPS = {133, 135, 138, 140, 141, 143}, {89: (1, 0), 90: (1, 1), 91: (1, 2), 92: (2, 0), 93: (2, 1), 94: (2, 2)}
INVOKES = {182: "virtual", 183: "special", 184: "static", 185: "interface", 186: "dynamic"}

_ARG = pa.struct([("value", pa.int64()), ("literal", pa.string()), ("whole", pa.bool_())])
_SCHEMA = pa.schema([
    ("path", pa.string()), ("class", pa.string()), ("method", pa.string()), ("descriptor", pa.string()), ("block", pa.int32()), ("at", pa.int32()), ("line", pa.int32()), ("kind", pa.string()),
    ("owner", pa.string()), ("name", pa.string()), ("type", pa.string()), ("receiver", pa.int64()), ("args", pa.list_(_ARG)), ("dst", pa.int64()), ("problem", pa.string()),
])
DDL = f"path string, class string, method string, descriptor string, block int, at int, line int, kind string, owner string, name string, type string, receiver long, args {ARGS}, dst long, problem string"


class Code(NamedTuple):
    body: bytes
    handlers: list[tuple[int, int, int, int]]
    lines: list[tuple[int, int]]


class Reader:
    """Big-endian numbers one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str) -> Any:
        out = struct.unpack_from(f">{form}", self.data, self.at)
        self.at += struct.calcsize(f">{form}")
        return out if len(out) > 1 else out[0]

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise ValueError("class file ends early")
        self.at += n
        return self.data[self.at - n : self.at]


def parameters(descriptor: str) -> tuple[list[str], str]:
    """Types of the parameters and of the result of a method descriptor, as they are written there."""
    inside, _, result = descriptor[1:].partition(")")
    out, at = [], 0
    while at < len(inside):
        end = at
        while inside[end] == "[":
            end += 1
        end = inside.index(";", end) + 1 if inside[end] == "L" else end + 1
        out.append(inside[at:end])
        at = end
    return out, result


class ClassFile:
    """The parts of a class file that facts are made of."""

    def __init__(self, data: bytes):
        r = Reader(data)
        magic, _, self.major, count = r.take("IHHH")
        if magic != 0xCAFEBABE:
            raise ValueError("not a class file")
        self.pool: dict[int, tuple[int, Any]] = {}
        n = 1
        while n < count:
            tag = r.take("B")
            if tag == 1:
                # names with characters above U+FFFF are pairs of surrogates here
                self.pool[n] = tag, r.bytes(r.take("H")).replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            else:
                self.pool[n] = tag, r.bytes(POOL_SIZES[tag])
            n += 2 if tag in (5, 6) else 1
        _, this, above, n_interfaces = r.take("HHHH")
        self.name, self.above = self.named(this), self.named(above) if above else None
        self.interfaces = [self.named(r.take("H")) for _ in range(n_interfaces)]
        for _ in range(r.take("H")):
            r.take("HHH")
            self.attributes(r)
        self.methods = []
        for _ in range(r.take("H")):
            flags, name, descriptor = r.take("HHH")
            code = self.attributes(r).get("Code")
            self.methods.append((flags, self.text(name), self.text(descriptor), self.code(code) if code else None))
        self.bootstraps = []
        rest = self.attributes(r).get("BootstrapMethods")
        if rest:
            b = Reader(rest)
            for _ in range(b.take("H")):
                _, n = b.take("HH")
                self.bootstraps.append([b.take("H") for _ in range(n)])

    def attributes(self, r: Reader) -> dict[str, bytes]:
        out = {}
        for _ in range(r.take("H")):
            name, size = r.take("HI")
            out[self.text(name)] = r.bytes(size)
        return out

    def code(self, data: bytes) -> Code:
        r = Reader(data)
        body = r.bytes((r.take("HHI"))[2])
        handlers = [r.take("HHHH") for _ in range(r.take("H"))]
        table = self.attributes(r).get("LineNumberTable")
        lines = Reader(table) if table else None
        return Code(body, handlers, sorted(lines.take("HH") for _ in range(lines.take("H"))) if lines else [])

    def text(self, n: int) -> str:
        return self.pool[n][1]

    def named(self, n: int) -> str:
        return self.text(struct.unpack(">H", self.pool[n][1])[0]).replace("/", ".")

    def member(self, n: int) -> tuple[str | None, str, str]:
        """Owner, name and descriptor of a field, a method or a dynamic call."""
        tag, raw = self.pool[n]
        owner, pair = struct.unpack(">HH", raw)
        name, kind = struct.unpack(">HH", self.pool[pair][1])
        return None if tag in (17, 18) else self.named(owner), self.text(name), self.text(kind)

    def target(self, n: int) -> str | None:
        """The method that a dynamic call binds, if one is among what it is made with."""
        for k in self.bootstraps[struct.unpack(">HH", self.pool[n][1])[0]]:
            if self.pool[k][0] == 15:
                owner, name, _ = self.member(struct.unpack(">BH", self.pool[k][1])[1])
                return f"{owner}.{name}"
        return None

    def constant(self, n: int) -> tuple[str | None, bool]:
        """What is known of a loaded constant: its text, and whether it is a whole number."""
        tag, raw = self.pool[n]
        if tag in (3, 5):
            return str(int.from_bytes(raw, "big", signed=True)), True
        if tag == 4 or tag == 6:
            return repr(struct.unpack(">f" if tag == 4 else ">d", raw)[0]), False
        return (self.text(struct.unpack(">H", raw)[0]), False) if tag == 8 else (None, False)


def instructions(code: bytes) -> Iterator[tuple[int, int, Reader, int]]:
    """(place, opcode, reader at its operands, place of the next); wide forms give the opcode they widen, negated."""
    at = 0
    while at < len(code):
        op, r, first = code[at], Reader(code, at + 1), at
        if op in (170, 171):
            r.at += -r.at % 4
            _, low = struct.unpack_from(">ii", code, r.at)
            at = r.at + (12 + 4 * (struct.unpack_from(">i", code, r.at + 8)[0] - low + 1) if op == 170 else 8 + 8 * low)
        elif op == 196:
            op, r.at = -code[at + 1], at + 2
            at += 6 if op == -132 else 4
        else:
            at += 1 + OPERANDS.get(op, 0)
        yield first, op, r, at


def targets(op: int, at: int, r: Reader, after: int) -> list[int]:
    """Where an instruction leads to."""
    if op in (167, 200):
        return [at + r.take("h" if op == 167 else "i")]
    if 153 <= op <= 166 or op in (198, 199):
        return [after, at + r.take("h")]
    if op in (170, 171):
        other, low = r.take("ii")
        ways = [r.take("i") for _ in range(r.take("i") - low + 1)] if op == 170 else [r.take("ii")[1] for _ in range(low)]
        return sorted({at + other, *(at + w for w in ways)})
    return [] if 172 <= op <= 177 or op == 191 else [after]


class Method:
    """One method's code, run once over its blocks with values for what is on the stack and in the locals."""

    def __init__(self, own: ClassFile, static: bool, descriptor: str, code: Code):
        self.own, self.code, self.rows, self.known = own, code, [], {}
        self.next, self.block, self.at = 0, 0, 0
        self.meets: dict[int, dict] = defaultdict(lambda: defaultdict(set))  # block -> slot -> what it may be
        self.entry: dict[int, tuple[dict, list]] = {}
        locals_, slot = {}, 0
        for nth, kind in enumerate(([] if static else ["L"]) + parameters(descriptor)[0]):
            locals_[slot] = (self.value(), kind in "JD")
            self.row("parameter", name=str(nth), dst=locals_[slot][0])
            slot += 2 if kind in "JD" else 1
        self.steps = {at: (op, r.at, after) for at, op, r, after in instructions(code.body)}
        self.leads = {at: targets(op, at, Reader(code.body, start), after) for at, (op, start, after) in self.steps.items()}
        if {168, 169, 201, -169} & {op for op, _, _ in self.steps.values()}:
            raise ValueError("subroutines aren't followed")
        into, catches = Counter(w for ways in self.leads.values() for w in ways), {h for _, _, h, _ in code.handlers}
        # what is jumped to begins a block; where more than one way leads, values meet
        self.starts = {0} | catches | {w for at, ways in self.leads.items() if ways != [self.steps[at][2]] for w in ways}
        self.fresh = {0} | catches | {w for w, n in into.items() if n > 1}
        self.guarded = {low for low, _, _, _ in code.handlers}
        self.enter(0, locals_, [])
        todo, done = [0], set()
        while todo:
            start = todo.pop()
            if start not in done:
                done.add(start)
                todo += [w for w in self.run(start) if w not in done]
        self.prune()

    def value(self) -> int:
        self.next += 1
        return self.next - 1

    def row(self, kind: str, dst: int | None = None, args: list[int] = (), **rest) -> None:
        self.rows.append({"block": self.block, "at": self.at, "kind": kind, "dst": dst, "args": list(args), **rest})

    def enter(self, start: int, locals_: dict, stack: list) -> None:
        """A way into a block. Where several meet, each slot is a value of its own from the first on."""
        if start not in self.fresh:
            self.entry[start] = (dict(locals_), list(stack))
            return
        if start not in self.entry:
            new = lambda v: (self.value(), v[1])
            self.entry[start] = ({k: new(v) for k, v in locals_.items()}, [new(v) for v in stack])
        here, piled = self.entry[start]
        for slot, (own, _) in here.items():
            if slot in locals_:
                self.meets[start][own].add(locals_[slot][0])
        for (own, _), (v, _) in zip(piled, stack, strict=True):
            self.meets[start][own].add(v)

    def caught(self, locals_: dict) -> set[int]:
        """What is thrown here may be met by the handlers of this place, with the locals as they are."""
        ways = {h: kind for low, high, h, kind in self.code.handlers if low <= self.at < high}
        for h in ways:
            known = self.entry.get(h)
            thrown = (known[1][0][0] if known else -1, False)
            if not known:
                self.entry[h] = ({k: (self.value(), v[1]) for k, v in locals_.items()}, [(self.value(), False)])
                thrown = self.entry[h][1][0]
                was, self.block = self.block, h
                self.row("catch", dst=thrown[0], type=self.own.named(ways[h]) if ways[h] else None)
                self.block = was
            self.enter(h, locals_, [thrown])
        return set(ways)

    def run(self, start: int) -> list[int]:
        self.block = start
        locals_, stack = dict(self.entry[start][0]), list(self.entry[start][1])
        at, out = start, set()
        while True:
            op, operand, after = self.steps[at]
            self.at = at
            if at == start or at in self.guarded:
                out |= self.caught(locals_)
            self.step(op, Reader(self.code.body, operand), locals_, stack)
            ways = self.leads[at]
            if ways != [after] or after in self.starts:
                for w in ways:
                    self.enter(w, locals_, stack)
                return [*out, *ways]
            at = after

    def step(self, op: int, r: Reader, locals_: dict, stack: list) -> None:
        """What one instruction does to locals and stack."""
        wide, op = op < 0, abs(op)
        slot = lambda: r.take("H" if wide else "B")

        def push(kind: str | None, args: list[int] = (), two: bool = False, **rest) -> int:
            v = self.value()
            stack.append((v, two))
            if kind:
                self.row(kind, v, args, **rest)
            return v

        def const(literal: str | None, whole: bool, two: bool = False) -> None:
            v = push("const", name=literal, two=two)
            self.known[v] = (literal, whole)

        pop = lambda: stack.pop()[0]
        pops = lambda n: [stack.pop()[0] for _ in range(n)][::-1]

        def words(n: int) -> list:
            out = []
            while n > 0:
                out.insert(0, stack.pop())
                n -= 2 if out[0][1] else 1
            return out

        if op == 0:
            pass
        elif op <= 15:
            const(None if op == 1 else str(op - 3) if op <= 8 else str(op - 9) if op <= 10 else f"{op - 11 if op <= 13 else op - 14}.0", 2 <= op <= 10, op in (9, 10, 14, 15))
        elif op <= 17:
            const(str(r.take("b" if op == 16 else "h")), True)
        elif op <= 20:
            n = r.take("B" if op == 18 else "H")
            const(*self.own.constant(n), self.own.pool[n][0] in (5, 6) or (self.own.pool[n][0] == 17 and self.own.member(n)[2] in "JD"))
        elif op <= 45:
            stack.append(locals_[slot() if op <= 25 else (op - 26) % 4])
        elif op <= 53:
            push("load_index", pops(2), op in (47, 49))
        elif op <= 78:
            k, v = slot() if op <= 58 else (op - 59) % 4, stack.pop()
            locals_[k] = v
            if v[1]:
                locals_.pop(k + 1, None)
            self.caught(locals_)
        elif op <= 86:
            self.row("store_index", args=pops(3))
        elif op <= 88:
            words(op - 86)
        elif op <= 94:
            n, below = DUPS[op]
            top = words(n)
            under = words(below)
            stack += top + under + top
        elif op == 95:
            stack[-2:] = stack[:-3:-1]
        elif op <= 131:
            two = op % 2 == 1 if op >= 120 else op % 4 in (1, 3)
            push("unary" if 116 <= op <= 119 else "binary", pops(1 if 116 <= op <= 119 else 2), two)
        elif op == 132:
            k = slot()
            v = self.value()
            self.row("binary", v, [locals_[k][0]])
            locals_[k] = (v, False)
            self.caught(locals_)
        elif op <= 147:
            push("unary", pops(1), op in WIDENING)
        elif op <= 152:
            push("compare", pops(2))
        elif op <= 166 or op in (198, 199, 170, 171):
            self.row("branch", args=pops(2 if 159 <= op <= 166 else 1))
        elif op in (167, 200):
            pass
        elif op <= 177:
            self.row("return", args=pops(0 if op == 177 else 1))
        elif op <= 181:
            owner, name, kind = self.own.member(r.take("H"))
            value = [pop()] if op in (179, 181) else []
            base = pop() if op in (180, 181) else None
            if value:
                self.row("store_field", args=value, owner=owner, name=name, type=kind, receiver=base)
            else:
                push("load_field", two=kind in "JD", owner=owner, name=name, type=kind, receiver=base)
        elif op <= 186:
            n = r.take("H")
            owner, name, kind = self.own.member(n)
            types, result = parameters(kind)
            args = pops(len(types))
            rest = {"owner": owner, "name": name, "type": kind, "receiver": None if op in (184, 186) else pop()}
            if op == 186:
                rest["owner"] = self.own.target(n)
            if result == "V":
                self.row(INVOKES[op], None, args, **rest)
            else:
                push(INVOKES[op], args, result in "JD", **rest)
        elif op == 187:
            push("new", type=self.own.named(r.take("H")))
        elif op in (188, 189, 197):
            kind = None if op == 188 else self.own.named(r.take("H"))
            push("new_array", pops(r.take("B") if op == 197 else 1), type=kind)
        elif op == 190 or op == 193:
            push("unary", pops(1))
        elif op == 191:
            self.row("throw", args=pops(1))
        elif op == 192:
            kind = self.own.named(r.take("H"))
            push("copy", pops(1), type=kind)
        elif op in (194, 195):
            self.row("monitor", args=pops(1))
        else:
            raise ValueError(f"opcode {op}")

    def prune(self) -> None:
        """Values where ways meet that can only be one other value are that value."""
        may = {own: set(of) for block in self.meets.values() for own, of in block.items()}
        where = {own: block for block, slots in self.meets.items() for own in slots}
        same: dict[int, int] = {}

        def final(v: int) -> int:
            while v in same:
                v = same[v]
            return v

        changed = True
        while changed:
            changed = False
            for own, of in list(may.items()):
                left = {final(v) for v in of} - {own}
                if len(left) == 1:
                    same[own] = left.pop()
                    del may[own]
                    changed = True
        for r in self.rows:
            r["args"] = [final(v) for v in r["args"]]
            r["receiver"] = final(r["receiver"]) if r.get("receiver") is not None else None
        used = {v for r in self.rows for v in [*r["args"], r["receiver"]]}
        todo, needed = [v for v in used if v in may], set()
        while todo:
            own = todo.pop()
            if own not in needed:
                needed.add(own)
                todo += [v for v in map(final, may[own]) if v in may]
        for own in sorted(needed):
            self.rows += [{"block": where[own], "at": where[own], "kind": "phi", "dst": own, "args": [v], "receiver": None} for v in sorted({final(v) for v in may[own]} - {own})]


def class_rows(path: str, data: bytes) -> Iterator[dict]:
    """All rows of one class file."""
    own = ClassFile(data)
    base = {"path": path, "class": own.name}
    yield base | {"kind": "class", "type": own.above}
    for i in own.interfaces:
        yield base | {"kind": "implements", "type": i}
    for flags, name, descriptor, code in own.methods:
        here = base | {"method": name, "descriptor": descriptor}
        kind = "native" if flags & 0x100 else "abstract" if code is None else "method"
        yield here | {"kind": kind, "type": parameters(descriptor)[1]}
        if code is None:
            continue
        try:
            method = Method(own, bool(flags & 8), descriptor, code)
        except (ValueError, KeyError, IndexError, struct.error) as error:
            yield here | {"kind": "problem", "problem": f"{type(error).__name__}: {error}"[:200]}
            continue
        lines, n, line = code.lines, 0, None
        for r in sorted(method.rows, key=lambda r: r["at"]):
            while n < len(lines) and lines[n][0] <= r["at"]:
                line, n = lines[n][1], n + 1
            args = [{"value": v, "literal": method.known.get(v, (None, False))[0], "whole": method.known.get(v, (None, False))[1]} for v in r["args"]]
            yield here | r | {"line": line, "args": args}


def decoded(files: DataFrame) -> DataFrame:
    """Rows (DDL) of the class files among files(path, content binary). kind: class (type: its supertype), implements, method,
    native, abstract, and one for what each instruction does; problem: what can't be read, a class or a method.

    A null or empty content and a file that isn't a class gives nothing; a class that ends early gives one problem row."""
    ship(files.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows = list(class_rows(path, data.as_py()))
                except (ValueError, KeyError, IndexError, struct.error) as error:
                    rows = [{"path": path, "kind": "problem", "problem": f"{type(error).__name__}: {error}"[:200]}]
                for k in range(0, len(rows), 10000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 10000], schema=_SCHEMA)

    magic = F.coalesce(F.hex(F.substring("content", 1, 4)) == "CAFEBABE", F.lit(False))
    some = files.select(F.col("path").cast("string"), F.col("content").cast("binary")).where(magic)
    large = some.where(F.length("content") > LIMIT).select("path", F.lit("problem").alias("kind"), F.lit("larger than the limit").alias("problem"))
    return some.where(F.length("content") <= LIMIT).mapInArrow(run, DDL).unionByName(large, allowMissingColumns=True)


def function_of(*more: str):
    return F.concat(F.concat_ws(".", "class", "method"), "descriptor", *(F.lit(m) for m in more))


def calls(rows: DataFrame) -> DataFrame:
    """(path, func, at, line, callee, kind, arity, receiver, args, result) of all calls; a call of <init> is named for its class,
    one that binds a method at run time for that method."""
    met = rows.where(F.col("kind").isin(*INVOKES.values()))
    callee = F.when(F.col("name") == "<init>", F.col("owner")).when(F.col("kind") == "dynamic", F.coalesce("owner", "name")).otherwise(F.concat_ws(".", "owner", "name"))
    return met.select("path", function_of().alias("func"), "at", "line", callee.alias("callee"), "kind", F.size("args").alias("arity"), "receiver", "args", F.col("dst").alias("result"))


def supertypes(rows: DataFrame) -> DataFrame:
    """(sub, super) as calls.closure() takes them."""
    return rows.where("kind in ('class', 'implements') and type is not null").select(F.col("class").alias("sub"), F.col("type").alias("super")).distinct()


def natives(rows: DataFrame) -> DataFrame:
    """(class, method, descriptor) of methods without code here, as native_binding joins take them."""
    return rows.where("kind = 'native'").select("class", "method", "descriptor").distinct()


def flows(rows: DataFrame) -> DataFrame:
    """(func, src, dst, kind): values that one instruction makes of others, but for calls. What is read from an array comes from the
    array and not from the index."""
    of = F.transform(F.when(F.col("kind") == "load_index", F.slice("args", 1, 1)).otherwise(F.col("args")), lambda a: a["value"])
    made = rows.where(F.col("kind").isin("phi", "copy", "unary", "binary", "load_index")).select(function_of().alias("func"), F.explode(of).alias("src"), "dst", "kind")
    fields = rows.where("kind = 'load_field' and receiver is not null").select(function_of().alias("func"), F.col("receiver").alias("src"), "dst", "kind")
    return made.unionByName(fields).distinct()


def collection_facts(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(makers, uses, copies) as containers.replayed() takes them."""
    func, is_call = function_of(), F.col("kind").isin(*INVOKES.values())
    place = [func.alias("func"), "block", F.col("at").alias("pos")]
    made = (F.col("name") == "<init>") & is_call
    makers = rows.where(made).select(*place, F.col("receiver").alias("value"), F.col("owner").alias("type"), "args")
    use = ["func", "block", "pos", "value", "role", "method", "args", "result"]
    on = rows.where("receiver is not null").where(~F.coalesce(made, F.lit(False))).select(*place, F.col("receiver").alias("value"), F.when(is_call, "receiver").otherwise("other").alias("role"), F.col("name").alias("method"), "args", F.col("dst").alias("result"))
    given = rows.where("kind <> 'copy'").select(*place, F.explode("args").alias("a"), F.lit("other").alias("role"), F.col("name").alias("method"), F.expr(f"cast(array() as {ARGS})").alias("args"), F.col("dst").alias("result"))
    copies = rows.where("kind = 'copy'").select(func.alias("func"), "dst", F.col("args")[0]["value"].alias("src"))
    return makers, on.select(*use).unionByName(given.withColumn("value", F.col("a.value")).select(*use)), copies
