"""Comment and literal masks that keep the layout, tokens, and places in text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: line comment, block comment, string literals of each family of languages
_C = (r"//[^\n]*", r"/\*.*?(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?')
_HASH = (r"#[^\n]*", r"(?!)", r'"""(?:\\.|[^\\])*?(?:"""|\Z)|\'\'\'(?:\\.|[^\\])*?(?:\'\'\'|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?')
_SQL = (r"--[^\n]*", r"/\*.*?(?:\*/|\Z)", r"'(?:''|[^'])*'?|\"[^\"]*\"?")
#: Scripts count as comments of a page: neither is text that it shows.
_HTML = (r"(?!)", r"<!--.*?(?:-->|\Z)|<script[^>]*>.*?(?:</script>|\Z)", r"(?!)")
#: Plain text has neither comments nor literals.
_TEXT = (r"(?!)",) * 3
FAMILIES = {"html": _HTML, "text": _TEXT, **dict.fromkeys(("python", "ruby", "shell"), _HASH), "sql": _SQL}
_CACHE: dict = {}


def _pattern(language: str) -> re.Pattern:
    if language not in _CACHE:
        line, block, text = FAMILIES.get(language, _C)
        _CACHE[language] = re.compile(rf"(?P<comment>{line}|{block})|(?P<text>{text})", re.DOTALL)
    return _CACHE[language]


def blank(match: str) -> str:
    return re.sub(r"[^\n]", " ", match)


def mask(language: str, source: str, comments: bool = True, literals: bool = False) -> str:
    """The source with comments (and, if wanted, the inside of string literals) blanked; lines and columns stay."""

    def hide(m: re.Match) -> str:
        if m["comment"] is not None:
            return blank(m[0]) if comments else m[0]
        return m[0][0] + blank(m[0][1:-1]) + m[0][-1] if literals and len(m[0]) > 1 else m[0]

    return _pattern(language).sub(hide, source)


def tokens(language: str, source: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) with kind comment, text, number, name or sign."""
    at = 0
    rest = re.compile(r"(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$][\w$]*)|(?P<sign>[^\s\w])")
    for m in [*_pattern(language).finditer(source), None]:
        for n in rest.finditer(source, at, m.start() if m else len(source)):
            yield n.lastgroup, n.start(), n.end()
        if m:
            yield ("comment" if m["comment"] is not None else "text"), m.start(), m.end()
            at = m.end()


def masked(language, source, literals: bool = False) -> Column:
    """mask() over columns, in Arrow batches."""

    def run(language: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else mask(lang or "", s, literals=literals) for lang, s in zip(language, source, strict=True)], dtype=object)

    return F.pandas_udf(run, "string")(language, source)


def bare(language, source) -> Column:
    """Without comments and without the inside of literals."""
    return masked(language, source, True)


def token_list(language, source) -> Column:
    """tokens() over columns."""

    def run(language: pd.Series, source: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "lo": a, "hi": b, "value": s[a:b]} for k, a, b in tokens(lang or "", s or "")] for lang, s in zip(language, source, strict=True)])

    return F.pandas_udf(run, "array<struct<kind string, lo int, hi int, value string>>")(language, source)


def line_and_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """One-based line and column of a zero-based offset."""
    head = F.split(F.substring(text, F.lit(1), offset), "\n")
    return F.size(head), F.length(F.element_at(head, -1)) + 1


#: Two characters that no text has (noncharacters of Unicode; what has them anyway is read as if they were unknown ones).
_OPEN, _SHUT, _UNKNOWN = "\ufdd0", "\ufdd1", "\ufffd\ufffd"


def marked(text: Column, pattern: str) -> Column:
    """text with marks around every match of a pattern."""
    return F.regexp_replace(F.translate(text, _OPEN + _SHUT, _UNKNOWN), F.lit(pattern), F.lit(f"{_OPEN}$0{_SHUT}"))


def places(text: Column) -> Column:
    """The matches in marked() text as structs (lo, hi, value), offsets from 0."""

    def run(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            own, at = [], 0
            for k, part in enumerate((t or "").split(_OPEN)):
                value, _, rest = part.partition(_SHUT)
                if k:
                    own.append({"lo": at, "hi": at + len(value), "value": value})
                at += len(value) + len(rest)
            out.append(own)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<struct<lo int, hi int, value string>>")(text)
