"""Facts of Python sources: functions, calls, assignments and the value flow between them, one file a row.

Nodes are numbered within the file and made global as file_id << 32 | node. What the frontend doesn't model (attributes
set from elsewhere, generators, metaclasses) gives no flow. A file that doesn't parse gives one warning row.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import ship

_FACT = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("what", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("name", pa.string()), ("detail", pa.string()), ("number", pa.int32()), ("line", pa.int32())])
_FACT_DDL = "file_id long, path string, what string, a long, b long, name string, detail string, number int, line int"


class _Reader(ast.NodeVisitor):
    """Emits (what, a, b, name, detail, number, line): function, call, arg, flow, enter, leave, import."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.n = 0
        self.scopes: list[dict[str, int]] = [{}]
        self.functions: dict[str, tuple[list[str], dict[str, int], int]] = {}
        self.returns: list[int] = []
        self.owner = ["<module>"]

    def node(self) -> int:
        self.n += 1
        return self.n

    def flow(self, a: int | None, b: int | None, kind: str = "flow", site: int = 0) -> None:
        if a and b:
            self.rows.append((kind, a, b, None, None, site, 0))

    def name_of(self, e: ast.AST) -> str:
        if isinstance(e, ast.Name):
            return e.id
        if isinstance(e, ast.Attribute):
            return f"{self.name_of(e.value)}.{e.attr}"
        return f"{self.name_of(e.func)}()" if isinstance(e, ast.Call) else "?"

    def value(self, e: ast.AST | None) -> int | None:
        """The node that holds an expression's value."""
        if e is None or isinstance(e, ast.Constant):
            return None
        if isinstance(e, ast.Name):
            for scope in reversed(self.scopes):
                if e.id in scope:
                    return scope[e.id]
            return None
        if isinstance(e, ast.Call):
            return self.call(e)
        if isinstance(e, ast.Lambda):
            return None
        out = self.node()
        for child in ast.iter_child_nodes(e):
            if isinstance(child, ast.expr):
                self.flow(self.value(child), out)
            elif isinstance(child, ast.comprehension):
                it = self.value(child.iter)
                self.bind(child.target, it)
                self.flow(it, out)
        return out

    def call(self, e: ast.Call) -> int:
        out, name = self.node(), self.name_of(e.func)
        receiver = self.value(e.func.value) if isinstance(e.func, ast.Attribute) else None
        self.rows.append(("call", out, receiver or 0, name, self.owner[-1], len(e.args), e.lineno))
        formals = self.functions.get(name)
        self.flow(receiver, out)
        for i, arg in enumerate([*e.args, *[k.value for k in e.keywords]]):
            v = self.value(arg)
            label = e.keywords[i - len(e.args)].arg if i >= len(e.args) else None
            port = self.node()
            self.flow(v, port)
            constant = repr(arg.value) if isinstance(arg, ast.Constant) else None
            self.rows.append(("arg", out, port, label, constant, i, e.lineno))
            if formals:
                names, nodes, _ = formals
                to = label if label in nodes else names[i] if i < len(names) and label is None else None
                if to:
                    self.flow(port, nodes[to], "enter", out)
            else:
                self.flow(port, out)  # a call that isn't known hands its arguments through
        if formals:
            self.flow(formals[2], out, "leave", out)
        return out

    def bind(self, target: ast.AST, v: int | None) -> None:
        if isinstance(target, ast.Name):
            new = self.node()
            self.flow(v, new)
            self.scopes[-1][target.id] = new
        elif isinstance(target, ast.Tuple | ast.List):
            for t in target.elts:
                self.bind(t, v)
        elif isinstance(target, ast.Subscript | ast.Attribute):
            self.flow(v, self.value(target.value))

    def visit_Module(self, node: ast.Module) -> None:
        for f in ast.walk(node):  # signatures first, so calls may stand before definitions
            if isinstance(f, ast.FunctionDef | ast.AsyncFunctionDef):
                names = [a.arg for a in [*f.args.posonlyargs, *f.args.args]]
                self.functions[f.name] = names, {a.arg: self.node() for a in [*f.args.posonlyargs, *f.args.args, *f.args.kwonlyargs]}, self.node()
        self.generic_visit(node)

    def visit_FunctionDef(self, node) -> None:
        names, nodes, out = self.functions[node.name]
        self.rows.append(("function", out, 0, node.name, ",".join(names), len(names), node.lineno))
        self.scopes.append(dict(nodes))
        self.returns.append(out)
        self.owner.append(node.name)
        for s in node.body:
            self.visit(s)
        self.scopes.pop()
        self.returns.pop()
        self.owner.pop()

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Return(self, node: ast.Return) -> None:
        v = self.value(node.value)
        if self.returns:
            self.flow(v, self.returns[-1])

    def visit_Assign(self, node: ast.Assign) -> None:
        v = self.value(node.value)
        for t in node.targets:
            self.bind(t, v)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self.bind(node.target, self.value(node.value))

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        old = self.value(node.target)
        self.bind(node.target, self.value(node.value))
        self.flow(old, self.value(node.target))

    def visit_For(self, node: ast.For) -> None:
        self.bind(node.target, self.value(node.iter))
        for s in [*node.body, *node.orelse]:
            self.visit(s)

    def visit_With(self, node: ast.With) -> None:
        for item in node.items:
            v = self.value(item.context_expr)
            if item.optional_vars is not None:
                self.bind(item.optional_vars, v)
        for s in node.body:
            self.visit(s)

    def visit_If(self, node: ast.If) -> None:
        """Both branches' bindings meet after the statement."""
        self.value(node.test)
        before = dict(self.scopes[-1])
        for s in node.body:
            self.visit(s)
        then = dict(self.scopes[-1])
        self.scopes[-1] = before
        for s in node.orelse:
            self.visit(s)
        for name, v in then.items():
            other = self.scopes[-1].get(name)
            if other != v:
                new = self.node()
                self.flow(v, new)
                self.flow(other, new)
                self.scopes[-1][name] = new

    def visit_Expr(self, node: ast.Expr) -> None:
        self.value(node.value)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            self.rows.append(("import", 0, 0, a.name, a.asname, 0, node.lineno))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        for a in node.names:
            self.rows.append(("import", 0, 0, f"{node.module or ''}.{a.name}", a.asname, node.level, node.lineno))


def read_source(text: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as error:
        return [("warning", 0, 0, type(error).__name__, str(error)[:200], 0, 0)]
    reader = _Reader()
    reader.visit(tree)
    return reader.rows


def facts(files: DataFrame) -> DataFrame:
    """Facts of files(file_id, path, content)."""
    ship(files.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for file_id, path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                high = (file_id or 0) << 32
                out += [(file_id, path, what, high | a if a else None, high | c if c else None, name, detail, number, line) for what, a, c, name, detail, number, line in read_source(text or "")]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FACT, strict=True)], schema=_FACT)

    return files.select(F.col("file_id").cast("long"), F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(run, _FACT_DDL)


def call_sites(rows: DataFrame) -> DataFrame:
    """Calls as the matcher wants them."""
    calls = rows.where("what = 'call'")
    none, texts = (lambda t: F.lit(None).cast(t)), "array<string>"
    return calls.select(
        F.lit("python").alias("language"), "path", "line", F.col("file_id").alias("func_id"), F.col("a").alias("node"), F.col("detail").alias("function_name"), F.col("name").alias("callee_name"),
        F.element_at(F.split("name", r"\."), -1).alias("method_name"), none("string").alias("receiver_type"), none(texts).alias("receiver_type_candidates"), none("int").alias("receiver_parameter"),
        none("string").alias("receiver_origin"), F.col("number").alias("arg_count"), none(texts).alias("arg_types"), none("array<array<string>>").alias("arg_type_candidates"),
    )


def flow_edges(rows: DataFrame) -> DataFrame:
    """Edges as the taint search wants them."""
    none = F.lit(None).cast("array<string>")
    return rows.where("what in ('flow', 'enter', 'leave')").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("what").alias("kind"), F.col("number").cast("long").alias("site"), none.alias("remove"), none.alias("add"))


# --- instructions for the per-function analyses ------------------------------------------------------------------------
class _Lowering(ast.NodeVisitor):
    """Blocks, instructions and branches of one function. Every binding is a new value; a name is one slot, written by copies, so
    values meet where control does (ssa.to_ssa tells them apart).

    Leaving a block early (return, break, continue, raise) runs, on its way, what stands between: finally bodies and exits of
    with statements, each a copy of its own. Within a try any statement may end before it begins or after it is done, and
    go to the handlers."""

    def __init__(self):
        self.insts: list[tuple] = []
        self.cfg: list[tuple] = []
        self.block, self.blocks, self.values = 0, 1, 0
        self.slots: dict[str, int] = {}
        self.lengths: dict[str, int] = {}
        self.pos: dict[int, int] = {}
        #: what is around a statement, outermost first: ("loop", head, after), ("last", what runs on the way out), ("try", handlers)
        self.around: list[tuple] = []

    def new(self) -> int:
        self.values += 1
        return self.values

    def emit(self, kind: str, dst: int | None = None, src: int | None = None, const: int | None = None, op: str | None = None) -> int | None:
        at = self.pos.get(self.block, 0)
        self.pos[self.block] = at + 1
        self.insts.append((self.block, at, kind, dst, src, op, const))
        return dst

    def start(self) -> int:
        self.blocks += 1
        return self.blocks - 1

    def enter(self, block: int) -> None:
        """Go on in a block; it has an instruction even if nothing is done there."""
        self.block = block
        self.emit("nop")

    def edge(self, src: int, dst: int, kind: str = "goto", value: int | None = None, sense: bool | None = None, bound: int | None = None) -> None:
        self.cfg.append((src, dst, kind, value, sense, bound))

    def jump(self, dst: int) -> None:
        self.edge(self.block, dst)

    # --- values ---
    def slot(self, name: str) -> int:
        if name not in self.slots:
            self.slots[name] = self.new()
        return self.slots[name]

    def choice(self, test: ast.AST, sides: list) -> int:
        """A value that one of two sides gives, each a function that makes it."""
        out, blocks, after = self.new(), [self.start(), self.start()], self.start()
        self.branch(test, *blocks)
        for block, side in zip(blocks, sides, strict=True):
            self.enter(block)
            self.emit("copy", out, side())
            self.jump(after)
        self.enter(after)
        return out

    def value(self, e: ast.AST) -> int:
        if isinstance(e, ast.Constant):
            if e.value is None:
                return self.emit("null", self.new())
            whole = isinstance(e.value, int) and not isinstance(e.value, bool) and abs(e.value) < 1 << 62
            return self.emit("const", self.new(), const=e.value if whole else 0) if isinstance(e.value, int) else self.emit("alloc", self.new())
        if isinstance(e, ast.Name):
            return self.slots[e.id] if e.id in self.slots else self.emit("call", self.new(), op=e.id)
        if isinstance(e, ast.Attribute):
            return self.emit("deref", self.new(), self.value(e.value), op=e.attr)
        if isinstance(e, ast.Subscript):
            index = self.value(e.slice)
            length = self.lengths.get(e.value.id) if isinstance(e.value, ast.Name) else None
            self.emit("deref", self.new(), self.value(e.value))
            self.emit("index", None, index, const=length)
            return self.emit("call", self.new())
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add | ast.Sub | ast.Mult) and isinstance(e.right, ast.Constant) and type(e.right.value) is int and abs(e.right.value) < 1 << 62:
            n = -e.right.value if isinstance(e.op, ast.Sub) else e.right.value
            return self.emit("multiply" if isinstance(e.op, ast.Mult) else "add", self.new(), self.value(e.left), n)
        if isinstance(e, ast.UnaryOp) and isinstance(e.op, ast.USub):
            return self.emit("negate", self.new(), self.value(e.operand))
        if isinstance(e, ast.List | ast.Tuple | ast.Dict | ast.Set):
            for child in ast.iter_child_nodes(e):
                if isinstance(child, ast.expr):
                    self.value(child)
            return self.emit("alloc", self.new())
        if isinstance(e, ast.IfExp):
            return self.choice(e.test, [lambda: self.value(e.body), lambda: self.value(e.orelse)])
        if isinstance(e, ast.BoolOp):
            first, rest = e.values[0], e.values[1:]
            later = lambda: self.value(ast.BoolOp(e.op, rest) if len(rest) > 1 else rest[0])
            own = lambda: self.value(first)
            return self.choice(first, [later, own] if isinstance(e.op, ast.And) else [own, later])
        if isinstance(e, ast.NamedExpr):
            self.bind(e.target.id, e.value)
            return self.slots[e.target.id]
        if isinstance(e, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
            return self.comprehension(e)
        if isinstance(e, ast.Lambda):
            return self.nested(e, {a.arg for a in [*e.args.posonlyargs, *e.args.args, *e.args.kwonlyargs]})
        for child in ast.iter_child_nodes(e):
            if isinstance(child, ast.expr):
                self.value(child)
            elif isinstance(child, ast.keyword):
                self.value(child.value)
        return self.emit("call", self.new())

    def comprehension(self, e) -> int:
        """Loops within each other, whose names don't outlive them."""
        names = dict(self.slots)
        loops = []
        for g in e.generators:
            for n in ast.walk(g.target):
                if isinstance(n, ast.Name):
                    self.slots[n.id] = self.new()
            head, body, after = self.open_loop(g.target, g.iter)
            loops.append((head, after))
            self.enter(body)
            for test in g.ifs:
                then = self.start()
                self.branch(test, then, head)
                self.enter(then)
        for part in ([e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt]):
            self.value(part)
        for head, after in reversed(loops):
            self.jump(head)
            self.enter(after)
        self.slots = names
        return self.emit("alloc", self.new())

    def nested(self, node: ast.AST, own: set[str]) -> int:
        """A function within this one: a new object that takes the names along that it reads."""
        names = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)} - own
        for name in sorted(names & self.slots.keys()):
            self.emit("capture", None, self.slots[name], op=name)
        return self.emit("alloc", self.new())

    # --- bindings ---
    def bind(self, name: str, e: ast.AST) -> None:
        v = self.value(e)
        if isinstance(e, ast.List | ast.Tuple) and not any(isinstance(x, ast.Starred) for x in e.elts):
            self.lengths[name] = len(e.elts)
        else:
            self.lengths.pop(name, None)
        self.emit("copy", self.slot(name), v)

    def give(self, target: ast.AST, v: int) -> None:
        """A value, not an expression, to whatever stands on the left."""
        if isinstance(target, ast.Name):
            self.lengths.pop(target.id, None)
            self.emit("copy", self.slot(target.id), v)
        elif isinstance(target, ast.Tuple | ast.List):
            for t in target.elts:
                self.give(t, self.emit("call", self.new()))
        elif isinstance(target, ast.Starred):
            self.give(target.value, v)
        else:
            self.value(target)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name):
                self.bind(t.id, node.value)
            else:
                self.give(t, self.value(node.value))

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        if node.value is not None:
            self.visit_Assign(ast.Assign([node.target], node.value))

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        if isinstance(node.target, ast.Name):
            self.bind(node.target.id, ast.BinOp(node.target, node.op, node.value))
        else:
            self.value(node.value)
            self.value(node.target)

    def visit_Delete(self, node: ast.Delete) -> None:
        for t in node.targets:
            if isinstance(t, ast.Name) and t.id in self.slots:
                self.emit("undefined", self.slots[t.id])
            elif not isinstance(t, ast.Name):
                self.value(t)

    def visit_Import(self, node) -> None:
        for a in node.names:
            self.emit("copy", self.slot((a.asname or a.name).split(".")[0]), self.emit("alloc", self.new()))

    visit_ImportFrom = visit_Import  # noqa: N815

    def visit_FunctionDef(self, node) -> None:
        own = {a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]}
        for d in node.decorator_list:
            self.value(d)
        self.emit("copy", self.slot(node.name), self.nested(node, own))  # its body is a function of its own

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        for e in [*node.bases, *(k.value for k in node.keywords), *node.decorator_list]:
            self.value(e)
        self.emit("copy", self.slot(node.name), self.nested(node, set()))

    def visit_Expr(self, node: ast.Expr) -> None:
        self.value(node.value)

    def visit_Global(self, node) -> None:
        pass

    visit_Nonlocal = visit_Pass = visit_Global  # noqa: N815

    # --- control ---
    def run(self, body: list) -> None:
        for s in body:
            handlers = next((x[1] for x in reversed(self.around) if x[0] == "try"), None)
            if handlers is not None:  # before and after a statement
                block = self.start()
                self.edge(self.block, handlers, "raise")
                self.jump(block)
                self.enter(block)
            self.visit(s)
            if handlers is not None:
                self.edge(self.block, handlers, "raise")

    def leave(self, upto: int) -> None:
        """Run what stands between here and the first `upto` of what is around, innermost first."""
        around = self.around
        for k in range(len(around) - 1, upto - 1, -1):
            if around[k][0] == "last":
                self.around = around[:k]
                around[k][1]()
        self.around = around

    def dead(self) -> None:
        self.enter(self.start())  # nothing leads here

    def visit_Return(self, node: ast.Return) -> None:
        v = self.value(node.value) if node.value is not None else None
        self.leave(0)
        self.emit("return", None, v)
        self.dead()

    def visit_Raise(self, node: ast.Raise) -> None:
        for e in (node.exc, node.cause):
            if e is not None:
                self.value(e)
        self.throw()
        self.dead()

    def throw(self) -> None:
        at = next((k for k in range(len(self.around) - 1, -1, -1) if self.around[k][0] == "try"), None)
        self.leave(0 if at is None else at + 1)
        if at is None:
            self.emit("raise")
        else:
            self.edge(self.block, self.around[at][1], "raise")

    def loop_exit(self, place: int) -> None:
        at = next((k for k in range(len(self.around) - 1, -1, -1) if self.around[k][0] == "loop"), None)
        if at is not None:
            self.leave(at + 1)
            self.jump(self.around[at][place])
            self.dead()

    def visit_Break(self, node: ast.Break) -> None:
        self.loop_exit(2)

    def visit_Continue(self, node: ast.Continue) -> None:
        self.loop_exit(1)

    def branch(self, test: ast.AST, then: int, other: int) -> None:
        """Edges of a condition: None tests and comparisons with a number are known, others only split."""
        at = self.block
        if isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.left, ast.Name) and test.left.id in self.slots and isinstance(test.comparators[0], ast.Constant):
            v, right, op = self.slots[test.left.id], test.comparators[0].value, test.ops[0]
            if right is None and isinstance(op, ast.Is | ast.Eq | ast.IsNot | ast.NotEq):
                null = isinstance(op, ast.Is | ast.Eq)
                self.edge(at, then, "null", v, null)
                self.edge(at, other, "null", v, not null)
                return
            if type(right) is int and abs(right) < 1 << 62 and isinstance(op, ast.Eq | ast.NotEq):
                self.edge(at, then, "eq", v, isinstance(op, ast.Eq), right)
                self.edge(at, other, "eq", v, isinstance(op, ast.NotEq), right)
                return
            if type(right) is int and abs(right) < 1 << 62 and isinstance(op, ast.Lt | ast.GtE | ast.LtE | ast.Gt):
                bound, less = (right, isinstance(op, ast.Lt)) if isinstance(op, ast.Lt | ast.GtE) else (right + 1, isinstance(op, ast.LtE))
                self.edge(at, then, "lt", v, less, bound)
                self.edge(at, other, "lt", v, not less, bound)
                return
        self.value(test)
        self.edge(self.block, then)
        self.edge(self.block, other)

    def visit_If(self, node: ast.If) -> None:
        then, other, after = self.start(), self.start(), self.start()
        self.branch(node.test, then, other)
        for block, body in ((then, node.body), (other, node.orelse)):
            self.enter(block)
            self.run(body)
            self.jump(after)
        self.enter(after)

    def visit_Assert(self, node: ast.Assert) -> None:
        fine, failed = self.start(), self.start()
        self.branch(node.test, fine, failed)
        self.enter(failed)
        if node.msg is not None:
            self.value(node.msg)
        self.throw()
        self.enter(fine)

    def open_loop(self, target: ast.AST, over: ast.AST) -> tuple[int, int, int]:
        """Head, body and end of a loop over something; the body begins by giving the target a value."""
        self.value(over)
        head, given, body, after = self.start(), self.start(), self.start(), self.start()
        self.jump(head)
        self.enter(head)
        self.emit("call", self.new())
        self.jump(given)
        self.jump(after)
        self.enter(given)
        self.give(target, self.emit("call", self.new()))
        self.jump(body)
        return head, body, after

    def close_loop(self, head: int, body: int, end: int, node) -> None:
        """Body and else part of a loop. `end` is where the loop ends by itself; break goes beyond the else part."""
        after = self.start()
        self.around.append(("loop", head, after))
        self.enter(body)
        self.run(node.body)
        self.jump(head)
        self.around.pop()
        self.enter(end)
        self.run(node.orelse)
        self.jump(after)
        self.enter(after)

    def visit_For(self, node) -> None:
        head, body, end = self.open_loop(node.target, node.iter)
        self.close_loop(head, body, end, node)

    visit_AsyncFor = visit_For  # noqa: N815

    def visit_While(self, node: ast.While) -> None:
        head, body, end = self.start(), self.start(), self.start()
        self.jump(head)
        self.enter(head)
        self.branch(node.test, body, end)
        self.close_loop(head, body, end, node)

    def visit_With(self, node) -> None:
        n = 0
        for item in node.items:
            v = self.value(item.context_expr)
            entered = self.emit("call", self.new(), v, op="__enter__")
            if item.optional_vars is not None:
                self.give(item.optional_vars, entered)
            self.around.append(("last", lambda v=v: self.emit("call", self.new(), v, op="__exit__")))
            n += 1
        self.run(node.body)
        for _ in range(n):
            last = self.around.pop()
            last[1]()

    visit_AsyncWith = visit_With  # noqa: N815

    def visit_Try(self, node) -> None:
        after, handlers = self.start(), self.start()
        if node.finalbody:
            self.around.append(("last", lambda: self.run(node.finalbody)))
        self.around.append(("try", handlers))
        self.run(node.body)
        self.around.pop()
        self.run(node.orelse)
        self.finish(node, after)
        own = [self.start() for _ in node.handlers]
        self.enter(handlers)
        dispatch = self.block
        for block, h in zip(own, node.handlers, strict=True):
            self.edge(dispatch, block)
            self.enter(block)
            if h.type is not None:
                self.value(h.type)
            if h.name:
                self.emit("copy", self.slot(h.name), self.emit("alloc", self.new()))
            self.run(h.body)
            self.finish(node, after)
        if not any(h.type is None for h in node.handlers):  # what no handler takes goes on outwards
            block = self.start()
            self.edge(dispatch, block)
            self.enter(block)
            self.throw()
        if node.finalbody:
            self.around.pop()
        self.enter(after)

    visit_TryStar = visit_Try  # noqa: N815

    def finish(self, node, after: int) -> None:
        """The ordinary way out of a try or a handler."""
        if node.finalbody:
            around = self.around
            self.around = around[:-1]
            self.run(node.finalbody)
            self.around = around
        self.jump(after)

    def visit_Match(self, node: ast.Match) -> None:
        self.value(node.subject)
        after = self.start()
        for case in node.cases:
            fits, other = self.start(), self.start()
            self.jump(fits)
            self.jump(other)
            self.enter(fits)
            for p in ast.walk(case.pattern):
                name = getattr(p, "name", None) or getattr(p, "rest", None)
                if isinstance(name, str):
                    self.emit("copy", self.slot(name), self.emit("call", self.new()))
            if case.guard is not None:
                then = self.start()
                self.branch(case.guard, then, other)
                self.enter(then)
            self.run(case.body)
            self.jump(after)
            self.enter(other)
        self.jump(after)
        self.enter(after)

    def visit_TypeAlias(self, node) -> None:
        self.emit("copy", self.slot(node.name.id), self.emit("alloc", self.new()))


def lower_function(node: ast.AST) -> tuple[list, list]:
    """(instructions, edges) of a function: rows of dataflow.INST_DDL and dataflow.CFG_DDL without func_id."""
    own = _Lowering()
    own.emit("call", own.new())
    for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]:
        own.slots[a.arg] = own.emit("call", own.new(), op=a.arg)
    own.run(node.body)
    own.emit("nop")
    return own.insts, own.cfg


def lower(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Instructions and edges of all functions of files(file_id, path, content); func_id is file_id << 32 | the function's
    number in the file."""
    from factloom.operators import dataflow

    ship(files.sparkSession)

    def rows_of(text: str, what: int) -> list[tuple]:
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return []
        functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        return [(k, *r) for k, n in enumerate(functions) for r in lower_function(n)[what]]

    def frame(what: int, ddl: str, schema: pa.Schema) -> DataFrame:
        def run(batches) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [((file_id or 0) << 32 | k, *r) for file_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, *r in rows_of(text or "", what)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        return files.select(F.col("file_id").cast("long"), F.col("content").cast("string")).mapInArrow(run, ddl)

    insts = pa.schema([("func_id", pa.int64()), ("block", pa.int32()), ("pos", pa.int32()), ("kind", pa.string()), ("dst", pa.int32()), ("src", pa.int32()), ("op", pa.string()), ("const", pa.int64())])
    cfg = pa.schema([("func_id", pa.int64()), ("src", pa.int32()), ("dst", pa.int32()), ("kind", pa.string()), ("cond_value", pa.int32()), ("cond_sense", pa.bool_()), ("bound", pa.int64())])
    return frame(0, dataflow.INST_DDL, insts), frame(1, dataflow.CFG_DDL, cfg)
