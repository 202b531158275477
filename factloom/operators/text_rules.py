"""Rules over source text: patterns on raw, comment-free and literal-free views, token kinds, search patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import masks
from factloom.session import broadcast_parts, ship_lean

RULE_DDL = "id string, language string, pattern string, view string, path_pattern string, severity string, cwe string, message string"
VIEWS = ("raw", "code", "bare")

#: Fixed values: (rule, severity, line pattern) of source that opens a shell to elsewhere, runs what it decodes, runs what it
#: downloads, or mines.
MALWARE = [
    ("reverse-shell", "critical", r"(?i)(/bin/(sh|bash)\s+-i\b|nc\s+-e\s+/bin/|bash\s+-i\s*>&\s*/dev/tcp/)"),
    ("obfuscated-eval", "high", r"(?i)eval\s*\(\s*(atob|base64_decode|Buffer\.from\([^,]+,\s*['\"]base64['\"]\))"),
    ("pipe-to-shell", "high", r"(?i)(curl|wget)\s+[^\n|]*\|\s*(sudo\s+)?(sh|bash|zsh)\b"),
    ("crypto-miner", "high", r"(?i)stratum\+tcp://|xmrig|monero.{0,20}pool"),
]


def scan(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files(language, path, content) x rules: (rule_id, path, line, col, excerpt, match, severity, cwe, message), once for
    equal places. A rule gives all its matches in a line, one after the other.

    Rule packs are configuration, hundreds to thousands of rows, and are read on the driver; all of them become one array
    expression over a line, so a line is read once and no rule is joined to it. Views are only made if a rule looks at
    them."""
    ship_lean(files.sparkSession)
    packs = rules.collect()
    views = {r["view"] or "code" for r in packs} - {"raw"}
    made = {"code": masks.masked("language", "content"), "bare": masks.bare("language", "content")}
    lines = lambda c: F.split(c, "\n")
    zipped = F.arrays_zip(lines(F.col("content")).alias("raw"), *(lines(F.col(v)).alias(v) for v in sorted(views)))
    rows = files.withColumns({v: made[v] for v in views}).select("language", "path", zipped.alias("z")).select("language", "path", F.posexplode("z").alias("n", "l"))

    def found(r) -> Column:
        seen = F.col(f"l.{r['view'] or 'code'}")
        fits = seen.rlike(r["pattern"])
        if r["language"] is not None:
            fits = (F.col("language") == r["language"]) & fits
        if r["path_pattern"] is not None:
            fits = F.col("path").rlike(r["path_pattern"]) & fits
        given = {"rule_id": r["id"], "severity": r["severity"], "cwe": r["cwe"], "message": r["message"]}
        return F.when(fits, F.struct(masks.marked(seen, r["pattern"]).alias("marked"), *(F.lit(v).cast("string").alias(k) for k, v in given.items())))

    if not packs:
        return rows.select(F.lit("").alias("rule_id"), "path", (F.col("n") + 1).alias("line"), F.lit(0).alias("col"), F.lit("").alias("excerpt"), F.lit("").alias("match"), *(F.lit("").alias(c) for c in ("severity", "cwe", "message"))).where("false")
    hits = rows.select("path", "n", "l.raw", F.explode(F.array_compact(F.array(*map(found, packs)))).alias("h"))
    hits = hits.withColumn("m", F.explode(masks.places(F.col("h.marked"))))
    return hits.select("h.rule_id", "path", (F.col("n") + 1).alias("line"), (F.col("m.lo") + 1).alias("col"), F.col("raw").alias("excerpt"), F.col("m.value").alias("match"), "h.severity", "h.cwe", "h.message")


def scan_tokens(files: DataFrame, kind: str, pattern: str) -> DataFrame:
    """(path, line, value) of the tokens of one kind that fit a pattern."""
    ship_lean(files.sparkSession)
    found = files.select("path", "content", F.explode(masks.token_list("language", "content")).alias("t")).where((F.col("t.kind") == kind) & F.col("t.value").rlike(pattern))
    return found.select("path", masks.line_and_column(F.col("content"), F.col("t.lo"))[0].alias("line"), F.col("t.value").alias("value"))


def malware(files: DataFrame) -> DataFrame:
    """(path, line, rule_id, severity, snippet) of lines that fit one of the four heuristics."""
    lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("n", "text"))
    hits = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"))) for r, s, p in MALWARE)))
    return lines.select("path", (F.col("n") + 1).alias("line"), F.explode(hits).alias("h"), F.trim("text").alias("snippet")).select("path", "line", "h.*", "snippet")


def search_pattern(pattern: str) -> str:
    """A search pattern with metavariables ($X, repeated ones must agree) and `...` as a regular expression. White space around
    signs is free, but not before and after the whole."""
    out, seen = [], set()
    for part in re.split(r"(\$[A-Z_]+|\.\.\.|\s+)", pattern.strip()):
        if part == "...":
            out.append(r"[\s\S]*?")
        elif part.startswith("$"):
            name = part[1:]
            out.append(rf"\k<{name.replace('_', '0')}>" if name in seen else rf"(?<{name.replace('_', '0')}>[\w.\[\]'\"]+)")
            seen.add(name)
        elif part.isspace():
            out.append(r"\s+")
        else:
            out.append(re.sub(r"([^\w])", r"\\s*\\\1\\s*", part) if part else "")
    return re.sub(r"^(\\s\*)+|(\\s\*)+$", "", "".join(out))


def search(files: DataFrame, either: list[str], inside: list[str] = (), without: list[str] = (), outside: list[str] = (), without_regex: list[str] = ()) -> DataFrame:
    """(path, line, match): code that fits one pattern, every time it does; it lies within a match of each pattern of `inside`,
    within none of `outside`, and no match of `without`, or of the regular expressions `without_regex`, overlaps it. Matches are
    ranges of a file, compared where they stand."""
    ship_lean(files.sparkSession)

    def ranges(p: str) -> Column:
        return masks.places(masks.marked(F.col("code"), p))

    some = lambda name, test: F.exists(F.col(name), test)
    groups = {"met": either, **{f"in{k}": [p] for k, p in enumerate(inside)}, "bad": without, "out": outside}
    groups = {name: [search_pattern(p) for p in patterns] + (list(without_regex) if name == "bad" else []) for name, patterns in groups.items()}
    rows = files.select("path", masks.masked("language", "content").alias("code"))
    rows = rows.where(F.greatest(*(F.col("code").rlike(search_pattern(p)) for p in [*either, *either])))
    none = F.array().cast("array<struct<lo int, hi int, value string>>")
    rows = rows.withColumns({name: F.array_distinct(F.flatten(F.array(*map(ranges, patterns)))) if patterns else none for name, patterns in groups.items()})
    rows = rows.withColumn("m", F.explode("met"))
    for name in groups:
        if name.startswith("in"):
            rows = rows.where(some(name, lambda r: (r["lo"] <= F.col("m.lo")) & (r["hi"] >= F.col("m.hi"))))
    rows = rows.where(~some("out", lambda r: (r["lo"] <= F.col("m.lo")) & (r["hi"] >= F.col("m.hi"))))
    rows = rows.where(~some("bad", lambda r: (r["lo"] < F.col("m.hi")) & (F.col("m.lo") < r["hi"])))
    return rows.select("path", masks.line_and_column(F.col("code"), F.col("m.lo"))[0].alias("line"), F.col("m.value").alias("match"))


def references(rows: DataFrame, key: str, text: str, pattern: str, group: int) -> DataFrame:
    """(key, target, n): what texts refer to by a pattern's group, as the imports of a file."""
    found = F.regexp_extract_all(text, F.lit(pattern), group)
    return rows.select(key, F.explode(found).alias("target")).groupBy(key, "target").agg(F.count("*").alias("n"))


def java_imports(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, rule_id, name) of imports in files that fit a package pattern of packages(rule_id, pattern)."""
    names = files.where("language = 'java'").select("path", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"), 1)).alias("name"))
    first, *more = [names.join(part, F.regexp_like("name", "pattern")).select("path", "rule_id", "name") for part in broadcast_parts(packages)]
    for rows in more:
        first = first.unionByName(rows)
    return first


def xpath_matches(trees: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(tree, rule_id, n): how many nodes of trees(tree, xml), syntax trees as XML, an XPath of rules(id, path) finds; only where
    it finds some. All rules are one XPath, so a tree is parsed once; the rules' ids are what is exploded, and n is never null, as
    Spark else computes again what it looks for empty arrays or nulls in."""
    if not rules:
        return trees.select("tree", F.lit("").alias("rule_id"), F.lit(0).alias("n")).where("false")
    every = "concat(" + "".join(f"count({p}),' '," for _, p in rules) + "'')"
    counted = trees.select("tree", F.split(F.xpath_string("xml", F.lit(every)), " ").alias("counts"))
    ids = F.array(*(F.struct(F.lit(i).alias("rule_id"), F.lit(k).alias("k")) for k, (i, _) in enumerate(rules)))
    each = counted.select("tree", "counts", F.explode(ids).alias("r"))
    return each.select("tree", "r.rule_id", F.coalesce(F.get("counts", F.col("r.k")).cast("int"), F.lit(0)).alias("n")).where("n > 0")


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Checked rules; equal ids are an error."""
    names = [f.split()[0] for f in RULE_DDL.split(", ")]
    for r in rules:
        re.compile(r["pattern"])
        if r.get("view", "code") not in VIEWS:
            raise ValueError(f"no view {r['view']!r}")
    if len({r["id"] for r in rules}) < len(rules):
        raise ValueError("rule ids repeat")
    return spark.createDataFrame([tuple(r.get(n, "code" if n == "view" else None) for n in names) for r in rules], RULE_DDL)
