"""Chat formatting by compiled templates (operator 2).

A template is parsed to a syntax tree, constants are folded, and the tree becomes Python closures that write a
conversation piece by piece, each with the flag whether it lies in a generation block (the loss mask). The language is
sandboxed: names, fields of a turn, literals, comparisons, and, or, not, in, `~` and `+`, `a if b else c`, a fixed set of
filters, and the statements for, if/elif/else, set and generation. There are no calls, no attributes of Python objects
and no loops but over what is given.

    {% for m in messages %}...{{ m.text | escape }}...{% if m.role == 'assistant' %}{% generation %}...{% endgeneration %}

`escape` puts a backslash before each backslash, '<', '[' and ']', so a text can't hold a control string and is got back
by dropping those backslashes.

Conversations stream: rows are dealt by conversation and sorted by turn, and a task holds one turn at a time, so a
conversation of any length needs no more memory than its longest turn.

Cases: null texts and roles are empty; rows that repeat a turn are kept, ordered by role and text; a null conv_id is a
conversation of its own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import record, ship

Write = Callable[[str, bool], None]
_ESCAPE = re.compile(r"[\\<\[\]]")
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


FILTERS: dict[str, Callable[[str], object]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}


class TemplateError(ValueError):
    """The template isn't in the language."""


# --- reading ---------------------------------------------------------------------------------------------------------
_TAG = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#.*?#\}", re.DOTALL)
_WORD = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>~+|().\[\]%-]))")
_KEYWORDS = frozenset("and or not in if else true false none".split())


def _unquote(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), s[1:-1], flags=re.DOTALL)


class Expression:
    """A recursive-descent parser: text -> tree of tuples."""

    def __init__(self, text: str):
        self.words, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _WORD.match(text, at)
            if not m:
                raise TemplateError(f"can't read {text[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "text" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and self.peek() is not None:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} is missing")

    def whole(self) -> tuple:
        tree = self.choice()
        if self.at < len(self.words):
            raise TemplateError(f"{self.words[self.at][1]!r} is left over")
        return tree

    def choice(self) -> tuple:
        value = self.either()
        if self.take("if"):
            condition = self.either()
            return ("choice", condition, value, self.choice() if self.take("else") else ("const", ""))
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        left = self.joined()
        if op := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            return (op, left, self.joined())
        if self.peek() == "not":
            self.take("not")
            self.need("in")
            return ("not", ("in", left, self.joined()))
        return left

    def joined(self) -> tuple:
        left = self.filtered()
        while op := self.take("~", "+", "-", "%"):
            left = (op, left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.primary()
        while self.take("|"):
            kind, name = self.words[self.at] if self.at < len(self.words) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            value = ("filter", name, value)
        return value

    def primary(self) -> tuple:
        if self.at >= len(self.words):
            raise TemplateError("an expression ends early")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "text":
            return ("const", _unquote(word))
        if kind == "number":
            return ("const", int(word))
        if word == "(":
            value = self.choice()
            self.need(")")
            return value
        if kind != "name" or word in _KEYWORDS - {"true", "false", "none"}:
            raise TemplateError(f"{word!r} can't stand here")
        if word in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[word])
        value: tuple = ("name", word)
        while True:
            if self.take("."):
                kind, field = self.words[self.at] if self.at < len(self.words) else ("", "")
                self.at += 1
            elif self.take("["):
                kind, field = self.words[self.at] if self.at < len(self.words) else ("", "")
                self.at += 1
                if kind != "text":
                    raise TemplateError("a field's name must be a literal")
                field = _unquote(field)
                self.need("]")
            else:
                return value
            if field.startswith("_") or kind not in ("name", "text"):
                raise TemplateError(f"no field {field!r}")
            value = ("field", value, field)


def parse(source: str) -> list[tuple]:
    """The template as a list of nodes."""
    items, at = [], 0
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        before, after = m[1] or m[4], m[3] or m[6]
        if at and items and items[-1] == "strip":
            items.pop()
            text = text.lstrip()
        items.append(("text", text.rstrip() if before else text))
        if m[2] is not None:
            items.append(("print", Expression(m[2]).whole()))
        elif m[5] is not None:
            items.append(("tag", m[5].strip()))
        if after:
            items.append("strip")
        at = m.end()
    rest = source[at:]
    if items and items[-1] == "strip":
        items.pop()
        rest = rest.lstrip()
    items.append(("text", rest))
    nodes, left = _nest(items, 0, ())
    if left < len(items):
        raise TemplateError(f"{items[left][1]!r} closes nothing")
    return nodes


def _nest(items: list, at: int, ends: tuple) -> tuple[list, int]:
    out = []
    while at < len(items):
        kind, value = items[at]
        if kind == "text":
            out += [("print", ("const", value))] if value else []
        elif kind == "print":
            out.append((kind, value))
        else:
            word, _, rest = value.partition(" ")
            if word in ends:
                return out, at
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)\s*", rest)
                if not m:
                    raise TemplateError(f"for what? {rest!r}")
                body, at = _nest(items, at + 1, ("endfor",))
                out.append(("for", m[1], m[2], body))
            elif word == "if":
                arms, otherwise = [], []
                while True:
                    body, at = _nest(items, at + 1, ("elif", "else", "endif"))
                    arms.append((Expression(rest).whole(), body))
                    if at >= len(items):
                        break
                    word, _, rest = items[at][1].partition(" ")
                    if word == "else":
                        otherwise, at = _nest(items, at + 1, ("endif",))
                    if word != "elif":
                        break
                out.append(("if", arms, otherwise))
            elif word == "set":
                name, sign, expression = rest.partition("=")
                if not sign or not re.fullmatch(r"[A-Za-z_]\w*", name.strip()):
                    raise TemplateError(f"set what? {rest!r}")
                out.append(("set", name.strip(), Expression(expression).whole()))
            elif word == "generation":
                body, at = _nest(items, at + 1, ("endgeneration",))
                out.append(("generation", body))
            else:
                raise TemplateError(f"no statement {word!r}")
            if word in ("for", "generation") and at >= len(items) or at >= len(items):
                raise TemplateError(f"{value!r} is never closed")
        at += 1
    if ends:
        return out, at
    return out, at


# --- folding and compiling -------------------------------------------------------------------------------------------
def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b, "-": lambda a, b: a - b, "%": lambda a, b: a % b,
}


def fold(tree: tuple) -> tuple:
    """The expression with its constant parts computed."""
    op, *args = tree
    if op in ("const", "name"):
        return tree
    if op == "field":
        return ("field", fold(args[0]), args[1])
    if op == "filter":
        inner = fold(args[1])
        return ("const", FILTERS[args[0]](_text(inner[1]))) if inner[0] == "const" else ("filter", args[0], inner)
    args = [fold(a) for a in args]
    if op == "choice":
        return (args[1] if args[0][1] else args[2]) if args[0][0] == "const" else (op, *args)
    if op == "not":
        return ("const", not args[0][1]) if args[0][0] == "const" else (op, *args)
    if op in ("and", "or"):
        if args[0][0] == "const":
            return args[1] if bool(args[0][1]) == (op == "and") else args[0]
        return (op, *args)
    if all(a[0] == "const" for a in args):
        return ("const", _BINARY[op](args[0][1], args[1][1]))
    return (op, *args)


def _add(out: list[tuple], node: tuple) -> None:
    """Appends a node; neighbouring constants become one."""
    if node[0] == "print" and node[1][0] == "const":
        text = _text(node[1][1])
        if out and out[-1][0] == "print" and out[-1][1][0] == "const":
            text = out.pop()[1][1] + text
        if text:
            out.append(("print", ("const", text)))
    else:
        out.append(node)


def fold_nodes(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "print":
            _add(out, ("print", fold(node[1])))
        elif kind == "for":
            out.append(("for", node[1], node[2], fold_nodes(node[3])))
        elif kind == "generation":
            out.append(("generation", fold_nodes(node[1])))
        elif kind == "set":
            out.append(("set", node[1], fold(node[2])))
        else:
            arms, otherwise = [], fold_nodes(node[2])
            for condition, body in node[1]:
                condition = fold(condition)
                if condition[0] == "const":
                    if condition[1]:
                        otherwise = fold_nodes(body)
                        break
                    continue
                arms.append((condition, fold_nodes(body)))
            for x in [("if", arms, otherwise)] if arms else otherwise:
                _add(out, x)
    return out


def _value(tree: tuple) -> Callable[[dict], object]:
    op, *args = tree
    if op == "const":
        return lambda env, v=args[0]: v
    if op == "name":
        return lambda env, k=args[0]: env.get(k)
    if op == "field":
        of, field = _value(args[0]), args[1]

        def get(env):
            owner = of(env)
            return owner.get(field) if isinstance(owner, dict) else None

        return get
    if op == "filter":
        return lambda env, f=FILTERS[args[0]], v=_value(args[1]): f(_text(v(env)))
    parts = [_value(a) for a in args]
    if op == "choice":
        return lambda env: parts[1](env) if parts[0](env) else parts[2](env)
    if op == "not":
        return lambda env: not parts[0](env)
    if op == "and":
        return lambda env: parts[0](env) and parts[1](env)
    if op == "or":
        return lambda env: parts[0](env) or parts[1](env)
    return lambda env, f=_BINARY[op]: f(parts[0](env), parts[1](env))


def _steps(nodes: list[tuple], masked: bool) -> Callable[[dict, Write], None]:
    steps = []
    for node in nodes:
        kind = node[0]
        if kind == "print" and node[1][0] == "const":
            steps.append(lambda env, write, t=node[1][1]: write(t, masked))
        elif kind == "print":
            steps.append(lambda env, write, v=_value(node[1]): write(_text(v(env)), masked))
        elif kind == "generation":
            steps.append(_steps(node[1], True))
        elif kind == "set":
            steps.append(lambda env, write, k=node[1], v=_value(node[2]): env.__setitem__(k, v(env)))
        elif kind == "for":
            steps.append(_loop(node[1], node[2], _steps(node[3], masked)))
        else:
            arms = [(_value(c), _steps(b, masked)) for c, b in node[1]]
            steps.append(_arms(arms, _steps(node[2], masked)))

    def run(env: dict, write: Write) -> None:
        for step in steps:
            step(env, write)

    return run


def _arms(arms: list, otherwise: Callable) -> Callable:
    def run(env, write):
        for condition, body in arms:
            if condition(env):
                return body(env, write)
        return otherwise(env, write)

    return run


def _loop(name: str, over: str, body: Callable) -> Callable:
    def run(env, write):
        rows = iter(env.get(over) or ())
        outer = env.get("loop")
        row, index = next(rows, None), 0
        while row is not None:  # one row ahead, so that loop.last is known
            following = next(rows, None)
            env[name], env["loop"] = row, {"index0": index, "index": index + 1, "first": index == 0, "last": following is None}
            body(env, write)
            row, index = following, index + 1
        env["loop"] = outer

    return run


def compile_template(source: str) -> Callable[[Iterable[dict], Write], None]:
    """A function that writes the formatted conversation, given its turns in order, as pieces (text, in loss mask)."""
    steps = _steps(fold_nodes(parse(source)), False)
    return lambda messages, write: steps({"messages": messages}, write)


# --- the template of the query, and reading its output back -----------------------------------------------------------
TURNS = (
    "{%- for m in messages -%}"
    "{{ '<s>' ~ '[INST:' }}{{ m.role | escape }}] "
    "{%- if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{%- else %}{{ m.text | escape }}{% endif %}{{ ' [/INST]' ~ '</s>' }}"
    "{%- endfor -%}"
)
_TURN = re.compile(r"<s>\[INST:((?:[^\\\]]|\\.)*)\](.*) \[/INST\]</s>", re.DOTALL)


class TurnReader:
    """Reads formatted text piece by piece: the turns by the control strings alone, the loss text by the mask alone."""

    def __init__(self):
        self.buffer: list[str] = []
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turns_hash, self.loss_hash = sha256(), sha256()
        self.loss: list[str] = []

    def write(self, text: str, masked: bool) -> None:
        self.buffer.append(text)
        self.chars += len(text)
        if masked:
            self.loss.append(text)
        if text.endswith("</s>") and (m := _TURN.fullmatch("".join(self.buffer))):
            self.buffer = []
            self.turns += 1
            self.turns_hash.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
            loss = unescape("".join(self.loss))
            self.loss = []
            self.loss_chars += len(loss)
            self.loss_hash.update(loss.encode("utf-8", "surrogatepass"))

    def row(self, conv_id) -> tuple:
        if self.buffer:
            raise ValueError(f"conversation {conv_id} can't be read back")
        return conv_id, self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_OUT_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversations_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Sorted rows (conv_id, role, text) as conversations; each must be used up before the next."""
    rows = ((i, {"role": r or "", "text": t or ""}) for b in batches for i, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)

    def turns(conv) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead[0] == conv:
            yield ahead[1]
            ahead = next(rows, None)

    while ahead is not None:
        conv = ahead[0]
        own = turns(conv)
        yield conv, own
        for _ in own:
            pass


def sorted_turns(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def render(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """conv_id, the formatted text, and the loss mask as [start, end) pairs of code points. Holds one conversation's text
    in memory, as its row does."""
    ship(conversations.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.int64()))])

    def run(batches) -> Iterator[pa.RecordBatch]:
        write_all = compile_template(template)
        for conv, turns in conversations_of(batches):
            out, mask, at = [], [], 0

            def write(text: str, masked: bool) -> None:
                nonlocal at
                out.append(text)  # noqa: B023
                if masked and text:
                    mask.extend((at, at + len(text)))  # noqa: B023
                at += len(text)

            write_all(turns, write)
            yield record(schema, [conv], ["".join(out)], [mask])

    return sorted_turns(conversations).mapInArrow(run, "conv_id long, formatted string, loss array<long>")


def op2_chat_format(conversations: DataFrame, template: str = TURNS) -> DataFrame:
    """Format every conversation and digest what is read back from the formatted pieces and their mask."""
    ship(conversations.sparkSession)

    def run(batches) -> Iterator[pa.RecordBatch]:
        write_all = compile_template(template)
        rows = []
        for conv, turns in conversations_of(batches):
            reader = TurnReader()
            write_all(turns, reader.write)
            rows.append(reader.row(conv))
            if len(rows) >= 2000:
                yield record(_OUT, *map(list, zip(*rows, strict=True)))
                rows = []
        if rows:
            yield record(_OUT, *map(list, zip(*rows, strict=True)))

    return sorted_turns(conversations).mapInArrow(run, _OUT_DDL)
