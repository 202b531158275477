"""Rule packs from YAML or JSON files, as the frames that matchers and scans read.

A taint pack is a mapping with lists `sources` (id, language, matcher, out, kind), `sinks` (id, language, matcher, inputs, kind)
and `sanitizers` (id, language, matcher, kind); a text pack has an id, a title and a list `rules` (id, title, languages,
severity, confidence, pattern, cwe, message, matcher). Packs are configuration and are read on the driver. What a pack asks
for and isn't there (a field that no matcher has, a port that can't be read) is never passed over in silence: the rule is left
out and told in `skipped`.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from factloom.operators import matching, text_rules

try:  # JSON packs need nothing
    import yaml
except ImportError:
    yaml = None

#: Fields of a text rule's matcher that narrow where and what its pattern may match.
TEXT_FIELDS = {"path_pattern", "matched_text_not_pattern", "required_file_pattern", "exclude_preprocessor"}
_FIELDS = {f.name for f in fields(matching.Matcher)}


@dataclass
class Pack:
    """Rules as (id, language, Matcher, kind, ports) by role, text rules as text_rules.rules_frame wants them, and what was left
    out and why."""

    sources: list[tuple] = field(default_factory=list)
    sinks: list[tuple] = field(default_factory=list)
    sanitizers: list[tuple] = field(default_factory=list)
    texts: list[dict] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)

    def frame(self, spark: SparkSession, role: str) -> DataFrame:
        """(rule_id, language, matcher, kind, port): a row for each port of each rule of a role."""
        rules = getattr(self, role)
        kinds = spark.createDataFrame([(i, k, p) for i, _, _, k, ports in rules for p in ports], "rule_id string, kind string, port string")
        return matching.rules_frame(spark, [r[:3] for r in rules]).join(kinds, "rule_id")

    def text_frame(self, spark: SparkSession) -> DataFrame:
        return text_rules.rules_frame(spark, self.texts)


def parsed(text: str, name: str = "pack"):
    if yaml is not None:
        return yaml.safe_load(text)
    try:
        return json.loads(text)
    except ValueError as error:
        raise ValueError(f"{name} is no JSON, and no YAML reader is installed") from error


def read(*files: str) -> Pack:
    """The rules of all files in their order; of rules of one role with one id the first stays, as packs are laid over others."""
    out = Pack()
    for f in files:
        add(out, parsed(Path(f).read_text(encoding="utf-8"), f) or {})
    return out


def add(pack: Pack, tree: dict) -> None:
    if not isinstance(tree, dict):
        raise ValueError("a pack is a mapping")
    for role, ports in (("sources", "out"), ("sinks", "inputs"), ("sanitizers", None)):
        held = getattr(pack, role)
        for rule in tree.get(role) or ():
            if rule["id"] in {r[0] for r in held}:
                continue
            try:
                held.append(_taint_rule(rule, ports))
            except ValueError as error:
                pack.skipped.append((rule["id"], str(error)))
    for rule in tree.get("rules") or ():
        if rule["id"] in {r["rule"] for r in pack.texts}:
            continue
        try:
            pack.texts += _text_rules(rule)
        except ValueError as error:
            pack.skipped.append((rule["id"], str(error)))


def _taint_rule(rule: dict, ports: str | None) -> tuple:
    given = rule.get("matcher") or {}
    unknown = sorted(set(given) - _FIELDS)
    if unknown:
        raise ValueError(f"no such constraint: {', '.join(unknown)}")
    matcher = matching.Matcher(**given)
    try:
        matcher.check()
    except re.error as error:
        raise ValueError(f"no pattern: {error}") from error
    at = rule.get(ports) if ports else "return"
    at = [at] if isinstance(at, str) else list(at or ())
    if not at:
        raise ValueError(f"no {ports}")
    for p in at:
        matching.parse_port(p)
    return rule["id"], rule.get("language"), matcher, rule.get("kind") or "generic", at


def _text_rules(rule: dict) -> list[dict]:
    """A rule as rows of text_rules: one for each of its languages, or one for all."""
    matcher = rule.get("matcher") or {}
    unknown = sorted(set(matcher) - TEXT_FIELDS)
    if unknown:
        raise ValueError(f"no text rule: {', '.join(unknown)}")
    if not rule.get("pattern"):
        raise ValueError("no pattern")
    try:
        for p in (rule["pattern"], *(matcher[c] for c in sorted(TEXT_FIELDS - {"exclude_preprocessor"}) if c in matcher)):
            re.compile(p)
    except re.error as error:
        raise ValueError(f"no pattern: {error}") from error
    shared = {"rule": rule["id"], "pattern": rule["pattern"], "severity": rule.get("severity"), "cwe": ",".join(rule.get("cwe") or ()) or None, "message": rule.get("message") or rule.get("title"), "path_pattern": matcher.get("path_pattern")}
    shared |= {"except": matcher.get("matched_text_not_pattern"), "file_pattern": matcher.get("required_file_pattern"), "no_directives": bool(matcher.get("exclude_preprocessor"))}
    return [shared | {"id": rule["id"] if lang is None else f"{rule['id']} {lang}", "language": lang} for lang in rule.get("languages") or [None]]


def scan_texts(files: DataFrame, pack: Pack) -> DataFrame:
    """Findings of a pack's text rules over files(language, path, content), every match once: (rule_id, path, line, col,
    excerpt, match, severity, cwe, message)."""
    from pyspark.sql import functions as F

    spark = files.sparkSession
    names = ("id", "rule", "except", "file_pattern", "no_directives")
    more = spark.createDataFrame([tuple(r[n] for n in names) for r in pack.texts], "rule_id string, own string, but string, file_pattern string, no_directives boolean")
    found = text_rules.scan(files.select("language", "path", "content"), pack.text_frame(spark)).join(F.broadcast(more), "rule_id")
    found = found.where(F.col("but").isNull() | ~F.regexp_like("match", F.col("but"))).where(~F.col("no_directives") | ~F.startswith(F.ltrim("excerpt"), F.lit("#")))
    asked = [r["file_pattern"] for r in pack.texts if r["file_pattern"]]
    if asked:
        whole = files.select(F.col("path").alias("p"), F.explode(F.array_compact(F.array(*(F.when(F.col("content").rlike(a), F.lit(a)) for a in sorted(set(asked)))))).alias("has"))
        plain, wanting = found.where("file_pattern is null"), found.where("file_pattern is not null")
        found = plain.unionByName(wanting.join(whole, (F.col("path") == F.col("p")) & (F.col("file_pattern") == F.col("has")), "left_semi"))
    return found.select(F.col("own").alias("rule_id"), "path", "line", "col", "excerpt", "match", "severity", "cwe", "message").distinct()
