"""Platform conditions in three-valued logic, and conditional compilation under a platform."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Platform:
    """macros: defined names with values; undefined: names known not to be defined; others are unknown."""

    os: str | None = None
    arch: str | None = None
    macros: dict = field(default_factory=dict)
    undefined: frozenset = frozenset()
    features: frozenset | None = None


def evaluate(tree: tuple, p: Platform) -> bool | None:
    """("always",), ("never",), ("define", n), ("feature", n), ("os", n), ("arch", n), ("not", c), ("all", [c]), ("any", [c])."""
    op, *args = tree
    if op in ("always", "never"):
        return op == "always"
    if op == "define":
        return True if args[0] in p.macros else False if args[0] in p.undefined else None
    if op == "feature":
        return None if p.features is None else args[0] in p.features
    if op in ("os", "arch"):
        known = getattr(p, op)
        return None if known is None else known == args[0]
    if op == "not":
        v = evaluate(args[0], p)
        return None if v is None else not v
    values = [evaluate(c, p) for c in args[0]]
    end = op == "any"
    return end if end in values else None if None in values else not end


def column(tree: tuple, macros: Column, undefined: Column, os: Column, arch: Column) -> Column:
    """The same over columns: SQL's NULL logic is this lattice."""
    op, *args = tree
    if op in ("always", "never"):
        return F.lit(op == "always")
    if op == "define":
        return F.when(F.array_contains(macros, args[0]), True).when(F.array_contains(undefined, args[0]), False)
    if op in ("os", "arch"):
        return (os if op == "os" else arch) == args[0]
    if op == "not":
        return ~column(args[0], macros, undefined, os, arch)
    if op == "feature":
        return F.lit(None).cast("boolean")
    out = F.lit(op == "all")
    for c in args[0]:
        v = column(c, macros, undefined, os, arch)
        out = out & v if op == "all" else out | v
    return out


_WORD = re.compile(r"\s*(defined\s*\(\s*\w+\s*\)|defined\s+\w+|&&|\|\||[!()<>=]=?|\w+)")


def _expression(text: str, p: Platform) -> bool | None:
    """#if expressions of defined, names, numbers, comparisons, !, && and ||; anything else is unknown."""
    words, at, text = [], 0, text.split("//")[0].rstrip()
    while at < len(text):
        m = _WORD.match(text, at)
        if not m:
            return None
        words.append(m[1])
        at = m.end()

    def value(w: str) -> int | None:
        if re.fullmatch(r"\d+[uUlL]*|0[xX][0-9a-fA-F]+", w):
            return int(w.rstrip("uUlL"), 0)
        if w in p.macros:
            v = p.macros[w]
            return int(v) if str(v).lstrip("-").isdigit() else None
        return 0 if w in p.undefined else None

    def either() -> bool | None:
        out = both()
        while words and words[0] == "||":
            words.pop(0)
            v = both()
            out = True if True in (out, v) else None if None in (out, v) else False
        return out

    def both() -> bool | None:
        out = one()
        while words and words[0] == "&&":
            words.pop(0)
            v = one()
            out = False if False in (out, v) else None if None in (out, v) else True
        return out

    def one() -> bool | None:
        w = words.pop(0)
        if w == "!":
            v = one()
            return None if v is None else not v
        if w == "(":
            v = either()
            words.pop(0)
            return v
        if w.startswith("defined"):
            return evaluate(("define", re.findall(r"\w+", w)[1]), p)
        left = value(w)
        if words and words[0] in ("==", "!=", "<", ">", "<=", ">="):
            op, right = words.pop(0), value(words.pop(0))
            if left is None or right is None:
                return None
            return {"==": left == right, "!=": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[op]
        return None if left is None else left != 0

    try:
        out = either()
    except IndexError:
        return None
    return None if words else out


def live_code(source: str, p: Platform) -> str:
    """The source with branches that can't be compiled under the platform blanked; lines and columns stay."""
    out, stack = [], []  # (is live, some earlier branch surely taken)
    for line in source.splitlines(keepends=True):
        m = re.match(r"\s*#\s*(if|ifdef|ifndef|elif|else|endif)\b(.*)", line)
        above = all(s[0] for s in stack[:-1]) if m and m[1] in ("elif", "else", "endif") else all(s[0] for s in stack)
        if m:
            rest = m[2].strip()
            if m[1] in ("if", "ifdef", "ifndef"):
                v = _expression(rest, p) if m[1] == "if" else evaluate(("define", rest.split()[0] if rest else ""), p)
                v = (None if v is None else not v) if m[1] == "ifndef" else v
                stack.append([v is not False, v is True])
            elif m[1] == "elif" and stack:
                v = _expression(rest, p)
                stack[-1] = [not stack[-1][1] and v is not False, stack[-1][1] or v is True]
            elif m[1] == "else" and stack:
                stack[-1] = [not stack[-1][1], True]
            elif m[1] == "endif" and stack:
                stack.pop()
            out.append(line if above else re.sub(r"[^\r\n]", " ", line))
        else:
            out.append(line if above else re.sub(r"[^\r\n]", " ", line))
    return "".join(out)
