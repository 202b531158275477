"""Rule matching: API matchers over call sites, ports, taint conditions.

Rules are few and calls are many. A rule set is split on the driver by the strictest equality it demands (callee, method,
neither), so most calls meet their rules in an equi join with a broadcast side of checked size; the whole predicate is
tested on what meets. A constraint that isn't set is NULL in the rule and holds; a constraint on something that the call
doesn't know (NULL) fails.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.rulesets import literals

MATCHER_DDL = (
    "exact string, contains string, regex string, containing_function_regex string, receiver_type string, receiver_contains string, receiver_regex string, "
    "receiver_parameter int, method_name string, method_contains string, method_regex string, arg_count int, arg_count_min int, arg_count_max int, "
    "arg_types array<string>, arg_type_regexes array<string>, receiver_origin_regex string"
)
CALL_DDL = (
    "language string, func_id long, inst int, function_name string, callee_name string, method_name string, receiver_type string, receiver_type_candidates array<string>, "
    "receiver_parameter int, receiver_origin string, arg_count int, arg_types array<string>, arg_type_candidates array<array<string>>"
)
#: Rules are broadcast if their texts, counted, take at most so many bytes; more are joined by shuffles on their keys, and
#: those without a key are broadcast in parts.
BROADCAST_BYTES = 32 << 20


@dataclass
class Matcher:
    """One API matcher; what is None doesn't constrain."""

    exact: str | None = None
    contains: str | None = None
    regex: str | None = None
    containing_function_regex: str | None = None
    receiver_type: str | None = None
    receiver_contains: str | None = None
    receiver_regex: str | None = None
    receiver_parameter: int | None = None
    method_name: str | None = None
    method_contains: str | None = None
    method_regex: str | None = None
    arg_count: int | None = None
    arg_count_min: int | None = None
    arg_count_max: int | None = None
    arg_types: list = field(default_factory=list)
    arg_type_regexes: list = field(default_factory=list)
    receiver_origin_regex: str | None = None

    def check(self) -> None:
        values = [getattr(self, f.name) for f in fields(self)]
        if all(v in (None, []) for v in values):
            raise ValueError("a matcher needs a constraint")
        for name in ("regex", "containing_function_regex", "receiver_regex", "method_regex", "receiver_origin_regex"):
            if getattr(self, name) is not None:
                re.compile(getattr(self, name))
        if None not in (self.arg_count_min, self.arg_count_max) and self.arg_count_min > self.arg_count_max:
            raise ValueError("arg_count_min exceeds arg_count_max")


def rules_frame(spark: SparkSession, rules: list[tuple[str, str | None, Matcher]]) -> DataFrame:
    """(rule_id, language, matcher fields) of (id, language or None, matcher)."""
    for _, _, m in rules:
        m.check()
    names = [f.name for f in fields(Matcher)]
    return spark.createDataFrame([(i, lang, *(getattr(m, n) for n in names)) for i, lang, m in rules], f"rule_id string, rule_language string, {', '.join('m_' + x.strip() for x in MATCHER_DDL.split(', '))}")


def _text(actual: Column, exact: str | None = None, contains: str | None = None, regex: str | None = None) -> Column:
    """The set constraints hold for a text; false where the text is NULL and one is set."""
    tests = []
    if exact:
        tests.append(F.col(exact).isNull() | (actual == F.col(exact)))
    if contains:
        tests.append(F.col(contains).isNull() | F.contains(actual, F.col(contains)))
    if regex:
        tests.append(F.col(regex).isNull() | F.regexp_like(actual, F.col(regex)))
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return F.coalesce(out, F.lit(False))


def matches() -> Column:
    """The whole predicate over a call joined with a rule: cheap tests first, patterns last."""
    nothing = F.array().cast("array<string>")
    types = F.array_compact(F.concat(F.coalesce("receiver_type_candidates", nothing), F.array("receiver_type")))
    # two passes: exact and contains by one type, the pattern by one that may be another
    plain = F.col("m_receiver_type").isNull() & F.col("m_receiver_contains").isNull() | F.exists(types, lambda t: F.coalesce((F.col("m_receiver_type").isNull() | (t == F.col("m_receiver_type"))) & (F.col("m_receiver_contains").isNull() | F.contains(t, F.col("m_receiver_contains"))), F.lit(False)))
    pattern = F.col("m_receiver_regex").isNull() | F.exists(types, lambda t: F.regexp_like(t, F.col("m_receiver_regex")))
    count = lambda test, bound: F.col(bound).isNull() | F.coalesce(test, F.lit(False))
    at = lambda c, i: F.get(F.coalesce(F.col(c), nothing), i)
    none2 = F.array().cast("array<array<string>>")

    def argument(i: Column) -> Column:
        exact, regex = at("m_arg_types", i), at("m_arg_type_regexes", i)
        found = F.array_compact(F.concat(F.coalesce(F.get(F.coalesce("arg_type_candidates", none2), i), nothing), F.array(at("arg_types", i))))
        return (exact.isNull() | F.array_contains(found, exact)) & (regex.isNull() | F.exists(found, lambda t: F.regexp_like(t, regex)))

    size = F.greatest(F.size(F.coalesce("m_arg_types", nothing)), F.size(F.coalesce("m_arg_type_regexes", nothing)))
    arguments = (size <= 0) | F.forall(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: F.coalesce(argument(i), F.lit(False)))
    return (
        (F.col("rule_language").isNull() | F.col("rule_language").eqNullSafe(F.col("language")))
        & _text(F.col("callee_name"), "m_exact", "m_contains")
        & _text(F.col("method_name"), "m_method_name", "m_method_contains")
        & count(F.col("arg_count") == F.col("m_arg_count"), "m_arg_count")
        & count(F.col("arg_count") >= F.col("m_arg_count_min"), "m_arg_count_min")
        & count(F.col("arg_count") <= F.col("m_arg_count_max"), "m_arg_count_max")
        & count(F.col("receiver_parameter") == F.col("m_receiver_parameter"), "m_receiver_parameter")
        & plain
        & _text(F.col("callee_name"), regex="m_regex")
        & _text(F.col("receiver_origin"), regex="m_receiver_origin_regex")
        & _text(F.col("function_name"), regex="m_containing_function_regex")
        & _text(F.col("method_name"), regex="m_method_regex")
        & pattern
        & arguments
    )


def match_calls(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """calls x rules(rule_id, ...) that match: equi joins on the callee (an exact one, or the few that a pattern can mean) and
    on the method, and a join on the predicate alone for the rules that fix neither."""
    spark = calls.sparkSession
    size = rules.agg(F.sum(F.length(F.to_json(F.struct(*rules.columns))))).first()[0] or 0
    hint = F.broadcast if size <= BROADCAST_BYTES else (lambda r: r)
    patterns = [(r.m_regex, t) for r in rules.where("m_exact is null and m_regex is not null").select("m_regex").distinct().collect() for t in literals(r.m_regex) or ()]
    meant = spark.createDataFrame(patterns, "m_regex string, k string")
    by_callee = rules.where("m_exact is not null").withColumn("k", F.col("m_exact")).unionByName(rules.where("m_exact is null").join(meant, "m_regex").select(*rules.columns, "k"))
    others = rules.where("m_exact is null").join(meant.select("m_regex").distinct(), "m_regex", "left_anti").select(*rules.columns)
    by_method = others.where("m_method_name is not null").withColumn("k", F.col("m_method_name"))
    rest = others.where("m_method_name is null")
    out = calls.join(hint(by_callee), (calls["callee_name"] == F.col("k")) & matches()).drop("k")
    out = out.unionByName(calls.join(hint(by_method), (calls["method_name"] == F.col("k")) & matches()).drop("k"))
    parts = max(1, -(-size // BROADCAST_BYTES))
    for n in range(parts):
        out = out.unionByName(calls.join(F.broadcast(rest.where(F.pmod(F.xxhash64("rule_id"), F.lit(parts)) == n)), matches()))
    return out.select(*calls.columns, "rule_id")


def split_callee(callee: Column) -> tuple[Column, Column]:
    """(receiver type, method) of a qualified name; the receiver is NULL where there is none."""
    return F.nullif(F.regexp_extract(callee, r"^(.*?)(?:\.|::|->)[^.:>]*$", 1), F.lit("")), F.regexp_extract(callee, r"([^.:>]*)$", 1)


_PORT = re.compile(r"receiver|return|(?:named_or_all|named|member):(.*\S.*)|args_from(\d+)|args(\d+)\.\.=(\d+)|arg(\d+)")


def parse_port(text: str) -> tuple:
    """("arg", 2), ("args", 1, 3), ("args_from", 1), ("named", "x"), ...; raises where the text is no port."""
    m = _PORT.fullmatch(text)
    if not m:
        raise ValueError(f"{text!r} names no port")
    if m[2] is not None:
        return "args_from", int(m[2])
    if m[3] is not None:
        if int(m[3]) > int(m[4]):
            raise ValueError(f"{text!r} ends before it begins")
        return "args", int(m[3]), int(m[4])
    if m[5] is not None:
        return "arg", int(m[5])
    head, _, name = text.partition(":")
    return (head, name) if name else (head,)


def expand_ports(port: Column, arity: Column) -> Column:
    """The concrete ports of a port text for a call with so many arguments, as an array."""
    start_from = F.regexp_extract(port, r"^args_from(\d+)$", 1)
    start, end = (F.regexp_extract(port, r"^args(\d+)\.\.=(\d+)$", i) for i in (1, 2))
    numbers = lambda lo, hi: F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda i: F.concat(F.lit("arg"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    last = arity.cast("int") - 1
    whole = lambda c: F.try_to_number(F.nullif(c, F.lit("")), F.lit("999999999")).cast("int")
    return F.when(start_from != "", numbers(whole(start_from), last)).when(start != "", numbers(whole(start), F.least(whole(end), last))).otherwise(F.array(port))


def condition(tree: dict | tuple) -> Column:
    """A taint condition as a predicate over columns kinds (array), arg_types, arg_constants (arrays by argument), and
    receiver_type, receiver_constant: ("has_kind", k), ("is_type", port, exact, regex), ("value_matches", port, exact,
    regex), ("is_constant", port), ("not", c), ("all", [c]), ("any", [c]).

    The port's value is known for the receiver and for positional arguments; on any other port these tests are false."""
    op, *args = tree
    if op == "has_kind":
        return F.array_contains("kinds", args[0]) if args[0] else F.lit(False)
    if op == "not":
        return ~condition(args[0])
    if op in ("all", "any"):
        out = F.lit(op == "all")
        for c in args[0]:
            out = out & condition(c) if op == "all" else out | condition(c)
        return out
    kind, *rest = parse_port(args[0])
    if kind == "arg":
        value = F.get("arg_types" if op == "is_type" else "arg_constants", F.lit(rest[0]))
    elif kind == "receiver":
        value = F.col("receiver_type" if op == "is_type" else "receiver_constant")
    else:
        return F.lit(False)
    if op == "is_constant":
        return value.isNotNull()
    exact, regex = args[1], args[2] if len(args) > 2 else None
    test = value.isNotNull()
    if exact is not None:
        test = test & (value == exact)
    if regex is not None:
        test = test & F.regexp_like(value, F.lit(regex))
    return F.coalesce(test, F.lit(False))
