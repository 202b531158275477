"""Rule sets as rows: union with last-wins, retention of what requested ids need, literal keys of patterns, classes."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.operators.rows import last_wins



def merge(*sets: DataFrame) -> DataFrame:
    """Rule sets (family, id, ...) one after the other: of equal ids in a family the last definition holds, at its place."""
    out = None
    for n, rules in enumerate(sets):
        rows = rules.withColumn("__set", F.lit(n)).withColumn("__row", F.monotonically_increasing_id())
        out = rows if out is None else out.unionByName(rows)
    keyed = out.withColumn("__key", F.concat_ws("\x00", "family", "id")).withColumn("__order", F.struct("__set", "__row"))
    return last_wins(keyed, "__key", "__order").orderBy("__set", "__row").drop("__key", "__order", "__set", "__row")


def pack(*sets: DataFrame) -> DataFrame:
    """Rule packs (id, ...) side by side; an id in two of them, or twice in one, is an error."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    twice = out.groupBy("id").count().where("count > 1").select("id").limit(5).collect()
    if twice:
        raise ValueError(f"rule ids repeat: {sorted(r.id for r in twice)}")
    return out


def curated(rules: DataFrame, proxies: list[str], languages: list[str]) -> DataFrame:
    """rules(id, cwe, languages) without those whose weaknesses are all among `proxies`, which better rules stand for, and each
    without the languages given; a rule that has no language left goes too."""
    arrays = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    stand_in = (F.size("cwe") > 0) & (F.size(F.array_except("cwe", arrays(proxies))) == 0)
    left = rules.where(~F.coalesce(stand_in, F.lit(False))).withColumn("languages", F.array_except("languages", arrays(languages)))
    return left.where(F.size("languages") > 0)


def retain(rules: DataFrame, needs: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted rules and all that they need (needs(id, needed)), directly or through others; unknown ids are an error."""
    spark = rules.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], "node string")
    unknown = asked.join(rules.select(F.col("id").alias("node")), "node", "left_anti").collect()  # at most what was asked for
    if unknown:
        raise ValueError(f"unknown rules: {sorted(r.node for r in unknown)}")
    kept, _ = graph.reach(needs.select(F.col("id").alias("src"), F.col("needed").alias("dst")), asked, 1 << 20)
    return rules.join(kept.select(F.col("node").alias("id")), "id", "left_semi")


def literals(pattern: str, limit: int = 64) -> list[str] | None:
    """All texts that a pattern fits if it is anchored and they are few; None otherwise. Such rules join by equality."""
    from re import _constants as c  # the parser that re itself uses
    from re import _parser

    def expand(tree) -> list[str] | None:
        parts: list[list[str]] = []
        for op, arg in tree:
            if op is c.LITERAL:
                parts.append([chr(arg)])
            elif op is c.IN and all(o is c.LITERAL or o is c.RANGE for o, _ in arg):
                parts.append([chr(x) for o, v in arg for x in (range(v[0], v[1] + 1) if o is c.RANGE else [v])][: limit + 1])
            elif op is c.SUBPATTERN:
                parts.append(expand(arg[3]))
            elif op is c.BRANCH:
                own = [expand(b) for b in arg[1]]
                parts.append(None if None in own else [t for b in own for t in b])
            elif op is c.MAX_REPEAT and arg[1] is not c.MAXREPEAT and arg[1] <= 4:
                own = expand(arg[2])
                parts.append(None if own is None else ["".join(t) for n in range(arg[0], arg[1] + 1) for t in product(own, repeat=n)])
            elif op is c.AT and arg in (c.AT_BEGINNING, c.AT_END, c.AT_BEGINNING_STRING, c.AT_END_STRING):
                continue
            else:
                return None
            if parts[-1] is None:
                return None
            total = 1
            for p in parts:
                total *= len(p)
            if total > limit:
                return None
        return ["".join(t) for t in product(*parts)]

    try:
        tree = list(_parser.parse(pattern))
    except re.error:
        return None
    begins = tree and tree[0] in ((c.AT, c.AT_BEGINNING), (c.AT, c.AT_BEGINNING_STRING))
    ends = tree and tree[-1] in ((c.AT, c.AT_END), (c.AT, c.AT_END_STRING))
    found = expand(tree) if begins and ends else None
    return sorted(set(found)) if found is not None else None


#: The weakness of each sink kind, in every spelling.
CLASSES = {
    **dict.fromkeys(("sql", "sqli", "database"), "CWE-89"),
    **dict.fromkeys(("command", "cmd", "shell", "exec", "execenvsink", "viatypeof[args]"), "CWE-78"),
    **dict.fromkeys(("path", "path_traversal", "filesystem", "filesystem_readwrite", "filesystem_other"), "CWE-22"),
    **dict.fromkeys(("xss", "html", "returnedtouser"), "CWE-79"),
    **dict.fromkeys(("ssrf", "http", "requestsend_uri", "requestsend_data", "requestsend_metadata"), "CWE-918"),
    **dict.fromkeys(("code", "eval", "code_injection", "remotecodeexecution"), "CWE-94"),
    **dict.fromkeys(("deserialization", "unsafe_deserialization"), "CWE-502"),
    **dict.fromkeys(("format", "format_string"), "CWE-134"),
    **dict.fromkeys(("log", "logging"), "CWE-117"),
    **dict.fromkeys(("xml", "xxe", "xmlparser"), "CWE-611"),
    **dict.fromkeys(("redirect", "open_redirect"), "CWE-601"),
    "ldap": "CWE-90",
    "xpath": "CWE-643",
    **dict.fromkeys(("template", "ssti"), "CWE-1336"),
    **dict.fromkeys(("regex", "redos"), "CWE-1333"),
    "jndi": "CWE-74",
    **dict.fromkeys(("crypto", "weak_crypto"), "CWE-327"),
    **dict.fromkeys(("hash", "weak_hash"), "CWE-328"),
    **dict.fromkeys(("random", "weak_random"), "CWE-330"),
    **dict.fromkeys(("header", "crlf", "responseheadername", "responseheadervalue"), "CWE-113"),
    "trust_boundary": "CWE-501",
    "authentication": "CWE-522",
    "emailsend": "CWE-93",
}
#: Words of a category text (lower case, parted by single spaces, a space before and after) and the weakness
#: that they name; the first line that fits holds.
WORDS = (
    (" access control database", "CWE-566"),
    (" sql injection| sqli | sql inject| hql | nosql injection", "CWE-89"),
    (" command inject| os command| command execution| exec arg| process injection| shell inject", "CWE-78"),
    (" ldap", "CWE-90"),
    (" xpath", "CWE-643"),
    (" xml external| xxe| external entit", "CWE-611"),
    (" xml injection", "CWE-91"),
    (" cross site scripting| xss| html injection", "CWE-79"),
    (" open redirect| url redirect| unvalidated redirect", "CWE-601"),
    (" server side request forgery| ssrf| request forgery", "CWE-918"),
    (" header manipulation| response splitting| crlf| http header", "CWE-113"),
    (" log forging| log injection| log forge", "CWE-117"),
    (" dynamic code evaluation| code injection| code inject| eval injection| script injection", "CWE-94"),
    (" template injection| ssti", "CWE-1336"),
    (" deserializ", "CWE-502"),
    (" format string| format injection| uncontrolled format", "CWE-134"),
    (" path manipulation| path traversal| directory traversal| zip entry| zip slip| file inclusion| path inject", "CWE-22"),
    (" regular expression| redos| regex injection", "CWE-1333"),
    (" resource injection| connection string| parameter pollution", "CWE-99"),
    (" setting manipulation", "CWE-15"),
    (" privacy violation", "CWE-359"),
    (" system information leak| information leak| information exposure", "CWE-497"),
    (" file permission", "CWE-732"),
    (" insecure random| weak random| predictable random", "CWE-330"),
    (" weak hash| broken hash", "CWE-328"),
    (" weak encryption| weak cryptograph| broken crypto| risky crypto", "CWE-327"),
    (" trust boundary", "CWE-501"),
    (" formula injection| csv injection", "CWE-1236"),
    (" password management", "CWE-256"),
    (" hardcoded| hard coded", "CWE-798"),
    (" certificate validation| insecure tls| insecure ssl", "CWE-295"),
    (" buffer overflow| buffer overrun| out of bounds write| stack overflow| heap overflow", "CWE-120"),
    (" integer overflow| integer wrap", "CWE-190"),
    (" use after free", "CWE-416"),
    (" double free", "CWE-415"),
    (" null pointer| null dereference| null deref", "CWE-476"),
    (" memory leak", "CWE-401"),
    (" denial of service", "CWE-400"),
    (" json injection| injection", "CWE-74"),
)
#: The severity of findings without one, by sink kind.


def weakness(kind: Column) -> Column:
    """The weakness of a sink kind; NULL for kinds that name none."""
    known = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    return F.element_at(known, F.lower(kind))


def category_words(text: Column) -> Column:
    """The words of a category text in whatever spelling: humps, underscores and signs part words."""
    parted = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(parted), r"[^a-z0-9]+", " ")), F.lit(" "))


def category_class(text: Column) -> Column:
    """The weakness that a category text names first in the order of WORDS."""
    words = category_words(text)
    return F.coalesce(*(F.when(words.rlike(w), c) for w, c in WORDS))


def localized(texts: Column, language: str, fallback: Column) -> Column:
    """A message in the wanted language, else in English, else the fallback; blank texts don't count. texts: a map."""
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(said(F.element_at(texts, language)), said(F.element_at(texts, "en")), fallback)


def licences(files: DataFrame, corpus: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(path, licence, score) of files(path, content) against corpus(licence, text): cosine of word counts, the best at or
    above the threshold. Texts meet on words, so a file is compared only with licences that share words; the corpus is a
    fixed list of licence texts."""

    def counts(rows: DataFrame, key: str, text: str) -> DataFrame:
        words = rows.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), 0)).alias("w"))
        n = words.groupBy(key, "w").agg(F.count("*").alias("n"))
        return n.join(n.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm")), key)

    a, b = counts(files, "path", "content"), counts(corpus, "licence", "text")
    both = a.join(b.withColumnsRenamed({"n": "m", "norm": "norm_b"}), "w").groupBy("path", "licence").agg((F.sum(F.col("n") * F.col("m")) / (F.first("norm") * F.first("norm_b"))).alias("score"))
    best = both.where(F.col("score") >= threshold).groupBy("path").agg(F.max(F.struct("score", "licence")).alias("x"))
    return best.select("path", "x.licence", F.round("x.score", 4).alias("score"))


def distro(files: DataFrame) -> DataFrame:
    """(image, distro, release, data_key) from files(image, path, content): os-release, else marker files."""
    release = files.where(F.col("path").rlike(r"(^|/)(etc|usr/lib)/os-release$"))
    field = lambda name: F.nullif(F.regexp_extract("content", rf'(?m)^{name}="?([^"\n]+)"?$', 1), F.lit(""))
    named = release.select("image", field("ID").alias("distro"), field("VERSION_ID").alias("release"))
    marked = files.where(F.col("path").rlike(r"(^|/)etc/(alpine-release|debian_version|redhat-release)$")).select("image", F.when(F.col("path").rlike("alpine"), "alpine").when(F.col("path").rlike("debian"), "debian").otherwise("rhel").alias("distro"), F.regexp_extract("content", r"(\d+(?:\.\d+)*)", 1).alias("release"))
    out = named.withColumn("r", F.lit(0)).unionByName(marked.withColumn("r", F.lit(1))).groupBy("image").agg(F.min(F.struct("r", "distro", "release")).alias("x")).select("image", "x.distro", "x.release")
    short = F.when(F.col("distro") == "alpine", F.regexp_extract("release", r"^(\d+\.\d+)", 1)).when(F.col("distro") == "ubuntu", F.col("release")).otherwise(F.regexp_extract("release", r"^(\d+)", 1))
    return out.withColumn("data_key", F.concat_ws(":", "distro", short))
