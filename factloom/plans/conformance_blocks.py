"""Control flow and lattices on the supplied tables: the events of a user are the blocks of a function, in their order.

Every block leads to the next; some lead three ahead as well, or two back. What an event does to the function's one value is
its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.operators import dataflow, ssa
from factloom.plans.conformance import query
from factloom.session import table, written

#: Blocks of all functions, and their edges: ahead where `skip` holds, back where `back` does.
_BLOCKS_SQL = """
b AS (SELECT user_id AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_id, event_type, value FROM events), n AS (SELECT f, max(k) AS last FROM b GROUP BY f),
e AS (SELECT f, k AS s, k + 1 AS t, 1 AS way FROM b JOIN n USING (f) WHERE k < last UNION ALL SELECT f, k, k + 3, 3 FROM b JOIN n USING (f) WHERE {skip} AND k + 3 <= last UNION ALL SELECT f, k, k - 2, -2 FROM b WHERE {back} AND k >= 2)
"""
_LOOSE = _BLOCKS_SQL.format(skip="event_type = 'click'", back="event_type = 'error'").strip()
#: What is reached without passing d; d dominates what isn't there.
_AVOID_SQL = "r(f, d, k) AS (SELECT f, k, 0 FROM b WHERE k <> 0 UNION SELECT r.f, d, t FROM r JOIN e ON e.f = r.f AND s = r.k WHERE t <> d)"


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(f, k, last, event_id, event_type, value), written."""
    own = Window.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("f"), (F.row_number().over(own.orderBy("event_id")) - 1).alias("k"), (F.count("*").over(own) - 1).cast("int").alias("last"), "event_id", "event_type", "value")
    return written(rows, "blocks")


def edges(rows: DataFrame, skip: Column, back: Column, condition: tuple[str, int | None] | None = None) -> DataFrame:
    """The edges as dataflow.CFG_DDL. condition: kind and bound of a branch on value 0 where a block leads ahead; the next block
    follows where it holds."""
    kind, bound = condition or ("goto", None)
    fork = skip & (F.col("k") + 3 <= F.col("last"))
    asked = F.lit(condition is not None) & skip
    edge = lambda when, to, cond, sense: F.when(when, F.struct(to.alias("dst"), F.when(cond, kind).otherwise("goto").alias("kind"), F.when(cond, F.lit(0)).alias("cond_value"), F.when(cond, F.lit(sense)).alias("cond_sense"), F.when(cond, F.lit(bound).cast("long")).alias("bound")))
    k, never = F.col("k"), F.lit(False)
    every = F.array_compact(F.array(edge(k < F.col("last"), k + 1, asked, True), edge(fork, k + 3, asked, False), edge(back & (k >= 2), k - 2, never, True)))
    return rows.select(F.col("f").alias("func_id"), k.alias("src"), F.explode(every).alias("e")).select("func_id", "src", "e.*")


def steps(rows: DataFrame, kinds: dict[str, tuple[str, bool, bool]], const: dict[str, Column] | None = None) -> DataFrame:
    """One instruction a block as dataflow.INST_DDL. kinds: event type -> kind, whether it writes value 0, whether it reads it."""
    pick = lambda place, other: F.coalesce(*(F.when(F.col("event_type") == t, F.lit(v[place])) for t, v in kinds.items()), F.lit(other))
    number = F.coalesce(*(F.when(F.col("event_type") == t, c) for t, c in (const or {}).items()), F.lit(None)).cast("long")
    return rows.select(F.col("f").alias("func_id"), F.col("k").alias("block"), F.lit(0).alias("pos"), pick(0, "nop").alias("kind"), F.when(pick(1, False), F.lit(0)).alias("dst"), F.when(pick(2, False), F.lit(0)).alias("src"), F.lit(None).cast("string").alias("op"), number.alias("const"))


def loose(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = blocks(spark, sf_dir)
    return rows, edges(rows, F.col("event_type") == "click", F.col("event_type") == "error")


@query(f"""
WITH RECURSIVE {_LOOSE}, {_AVOID_SQL},
back AS (SELECT DISTINCT e.f, s, t AS h FROM e LEFT JOIN r ON r.f = e.f AND r.d = e.t AND r.k = e.s WHERE r.f IS NULL),
l(f, h, k) AS (SELECT f, h, s FROM back UNION SELECT f, h, h FROM back UNION SELECT l.f, h, e.s FROM l JOIN e ON e.f = l.f AND e.t = l.k WHERE l.k <> h)
SELECT f AS func_id, CAST(h AS INTEGER) AS head, CAST(k AS INTEGER) AS block FROM l
""")
def natural_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of loops whose head dominates their end."""
    rows, cfg = loose(spark, sf_dir)
    return ssa.natural_loops(ssa.code_of(steps(rows, {}), cfg))


@query(f"""
WITH RECURSIVE {_LOOSE}, {_AVOID_SQL},
dom AS (SELECT a.f, a.k AS d, b.k FROM b a JOIN b ON b.f = a.f LEFT JOIN r ON r.f = a.f AND r.d = a.k AND r.k = b.k WHERE r.f IS NULL),
df AS (SELECT DISTINCT p.f, p.d AS x, e.t AS y FROM dom p JOIN e ON e.f = p.f AND e.s = p.k LEFT JOIN dom q ON q.f = p.f AND q.d = p.d AND q.k = e.t AND q.k <> q.d WHERE q.f IS NULL),
live(f, k) AS (SELECT f, k FROM b WHERE event_type = 'view' UNION SELECT e.f, e.s FROM live JOIN e ON e.f = live.f AND e.t = live.k JOIN b ON b.f = e.f AND b.k = e.s WHERE event_type NOT IN ('purchase', 'signup')),
phi(f, k) AS (SELECT df.f, y FROM df JOIN b ON b.f = df.f AND b.k = x JOIN live ON live.f = df.f AND live.k = y WHERE event_type IN ('purchase', 'signup') UNION SELECT df.f, y FROM phi JOIN df ON df.f = phi.f AND x = phi.k JOIN live ON live.f = df.f AND live.k = y)
SELECT f AS func_id, CAST(k AS INTEGER) AS block, CAST(0 AS INTEGER) AS value FROM phi
""")
def phi_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks where definitions meet: on the frontiers of what defining blocks dominate, where the value is read later."""
    rows, cfg = loose(spark, sf_dir)
    return ssa.phi_places(ssa.code_of(steps(rows, {"purchase": ("const", True, False), "signup": ("call", True, False), "view": ("deref", False, True)}), cfg))


_GUARDED = _BLOCKS_SQL.format(skip="event_type = 'purchase'", back="event_type = 'error'").strip()


@query(f"""
WITH RECURSIVE {_GUARDED}, {_AVOID_SQL},
back AS (SELECT DISTINCT e.f, s, t AS h FROM e LEFT JOIN r ON r.f = e.f AND r.d = e.t AND r.k = e.s WHERE r.f IS NULL),
l(f, h, k) AS (SELECT f, h, s FROM back UNION SELECT f, h, h FROM back UNION SELECT l.f, h, e.s FROM l JOIN e ON e.f = l.f AND e.t = l.k WHERE l.k <> h),
o AS (SELECT l.f, l.h, l.k, count(*) AS ways, count(i.k) AS inside FROM l JOIN e ON e.f = l.f AND e.s = l.k LEFT JOIN l i ON i.f = l.f AND i.h = l.h AND i.k = e.t GROUP BY ALL)
SELECT o.f AS func_id, CAST(h AS INTEGER) AS head, CAST(o.k AS INTEGER) AS block, EXISTS (SELECT 1 FROM l JOIN b ON b.f = l.f AND b.k = l.k WHERE l.f = o.f AND l.h = o.h AND event_type = 'signup') AS inside
FROM o JOIN b ON b.f = o.f AND b.k = o.k WHERE event_type = 'purchase' AND inside > 0 AND inside < ways
""")
def loop_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches that decide how often a loop runs."""
    rows = blocks(spark, sf_dir)
    cfg = edges(rows, F.col("event_type") == "purchase", F.col("event_type") == "error", ("lt", 7))
    return ssa.loop_sinks(ssa.code_of(steps(rows, {"signup": ("call", True, False)}), cfg)).select("func_id", "head", "block", "inside")


@query("""
WITH RECURSIVE b AS (SELECT user_id AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_type, CAST(floor(value) AS HUGEINT) * 10000000000000000 AS c FROM events), n AS (SELECT f, max(k) AS last FROM b GROUP BY f),
o(f, k, x0, x1, x2) AS (SELECT f, CAST(0 AS BIGINT), {'how': 2, 'c': CAST(0 AS HUGEINT)}, {'how': 0, 'c': CAST(0 AS HUGEINT)}, {'how': 0, 'c': CAST(0 AS HUGEINT)} FROM n
UNION ALL SELECT y.f, y.k + 1, CASE WHEN x1.how = 0 THEN near WHEN near.how = 0 THEN x1 WHEN x1 = near THEN x1 ELSE {'how': 2, 'c': CAST(0 AS HUGEINT)} END, x2, far FROM (
SELECT z.*, CASE WHEN z.y.how = 0 OR event_type = 'purchase' AND z.y.how = 1 AND NOT z.y.c < 0 THEN {'how': 0, 'c': CAST(0 AS HUGEINT)} ELSE z.y END AS near,
CASE WHEN event_type <> 'purchase' OR z.y.how = 0 OR z.y.how = 1 AND z.y.c < 0 THEN {'how': 0, 'c': CAST(0 AS HUGEINT)} ELSE z.y END AS far FROM (
SELECT o.*, event_type, CASE WHEN x0.how = 0 THEN x0 WHEN event_type = 'signup' THEN {'how': 1, 'c': b.c} WHEN event_type = 'error' THEN {'how': 2, 'c': CAST(0 AS HUGEINT)}
WHEN event_type = 'click' AND x0.how = 1 THEN {'how': 1, 'c': x0.c + 5000000000000000000 - CASE WHEN x0.c + 5000000000000000000 > 9223372036854775807 THEN CAST(18446744073709551616 AS HUGEINT) ELSE 0 END} ELSE x0 END AS y FROM o JOIN b ON b.f = o.f AND b.k = o.k) z) y JOIN n ON n.f = y.f WHERE y.k < last)
SELECT f AS func_id, CAST(k AS INTEGER) AS block FROM o WHERE x0.how > 0
""")
def folded_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that are left when constants, with arithmetic that overflows, have decided branches."""
    rows = blocks(spark, sf_dir)
    cfg = edges(rows, F.col("event_type") == "purchase", F.lit(False), ("lt", 0))
    const = {"signup": F.floor("value").cast("long") * 10**16, "click": F.lit(5 * 10**18)}
    code = ssa.code_of(steps(rows, {"signup": ("const", True, False), "click": ("add", True, True), "error": ("call", True, False)}, const), cfg)
    return ssa.folded(ssa.to_ssa(code)).where("what = 'inst'").select("func_id", "block").distinct()


_NULLS = _BLOCKS_SQL.format(skip="event_type = 'purchase'", back="event_type = 'view' AND value > 250").strip()


@query(f"""
WITH RECURSIVE {_NULLS},
x(f, k, fact) AS (SELECT f, CAST(0 AS BIGINT), 'unknown' FROM n UNION SELECT * FROM (
SELECT o.f, t, CASE WHEN event_type <> 'purchase' THEN o WHEN way = 1 AND o IN ('null', 'unknown') THEN 'null' WHEN way = 3 AND o IN ('nonnull', 'unknown') THEN 'nonnull' END AS fact FROM (
SELECT x.f, x.k, event_type, CASE event_type WHEN 'error' THEN 'null' WHEN 'signup' THEN 'nonnull' WHEN 'click' THEN 'unknown' WHEN 'view' THEN 'nonnull' ELSE fact END AS o FROM x JOIN b ON b.f = x.f AND b.k = x.k) o JOIN e ON e.f = o.f AND e.s = o.k) WHERE fact IS NOT NULL)
SELECT x.f AS func_id, CAST(x.k AS INTEGER) AS block, CASE WHEN count(DISTINCT fact) = 1 THEN min(fact) ELSE 'unknown' END AS fact FROM x JOIN b ON b.f = x.f AND b.k = x.k WHERE event_type = 'view' GROUP BY ALL
""")
def nullness_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a value where it is read, over branches on null and loops."""
    rows = blocks(spark, sf_dir)
    cfg = edges(rows, F.col("event_type") == "purchase", (F.col("event_type") == "view") & (F.col("value") > 250), ("null", None))
    insts = steps(rows, {"error": ("null", True, False), "signup": ("alloc", True, False), "click": ("call", True, False), "view": ("deref", False, True)})
    return dataflow.nullness(insts, cfg).select("func_id", "block", "fact")


_LIVES = _BLOCKS_SQL.format(skip="event_type = 'click'", back="event_type = 'view' AND value > 250").strip()


@query(f"""
WITH RECURSIVE {_LIVES},
x(f, k, state) AS (SELECT e.f, t, CASE event_type WHEN 'signup' THEN 'owned' WHEN 'error' THEN 'freed' ELSE 'moved' END FROM b JOIN e ON e.f = b.f AND e.s = b.k WHERE event_type IN ('signup', 'error', 'purchase')
UNION SELECT e.f, t, state FROM x JOIN b ON b.f = x.f AND b.k = x.k JOIN e ON e.f = x.f AND e.s = x.k WHERE event_type IN ('click', 'view')),
s AS (SELECT x.f, x.k, event_type, CASE WHEN count(DISTINCT state) = 1 THEN min(state) WHEN bool_or(state = 'freed') THEN 'maybe_freed' WHEN bool_or(state = 'moved') THEN 'maybe_moved' END AS state FROM x JOIN b ON b.f = x.f AND b.k = x.k GROUP BY ALL),
p AS (SELECT f, k, CASE WHEN event_type = 'error' THEN CASE state WHEN 'freed' THEN 'double_free' WHEN 'maybe_freed' THEN 'possible_double_free' END
WHEN event_type = 'view' THEN CASE state WHEN 'freed' THEN 'use_after_free' WHEN 'maybe_freed' THEN 'possible_use_after_free' WHEN 'moved' THEN 'use_after_move' WHEN 'maybe_moved' THEN 'possible_use_after_move' END END AS problem FROM s)
SELECT f AS func_id, CAST(k AS INTEGER) AS block, problem FROM p WHERE problem IS NOT NULL
""")
def lifetimes_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses after a release, certain or possible, over branches and loops."""
    rows = blocks(spark, sf_dir)
    cfg = edges(rows, F.col("event_type") == "click", (F.col("event_type") == "view") & (F.col("value") > 250))
    insts = steps(rows, {"signup": ("alloc", True, False), "error": ("free", False, True), "purchase": ("move", False, True), "view": ("deref", False, True)})
    return dataflow.lifetimes(insts, cfg).select("func_id", "block", "problem")


@query("""
WITH RECURSIVE b AS (SELECT user_id AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, event_type, floor(value) AS c FROM events), n AS (SELECT f, max(k) AS last FROM b GROUP BY f),
o(f, k, l0, h0, l1, h1, l2, h2) AS (SELECT f, CAST(0 AS BIGINT), '-Infinity'::DOUBLE, 'Infinity'::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM n
UNION ALL SELECT z.f, z.k + 1, least(l1, nl), greatest(h1, nh), l2, h2, fl, fh FROM (
SELECT y.*, CASE WHEN event_type <> 'purchase' THEN lo WHEN lo <= least(hi, 199) THEN lo END AS nl, CASE WHEN event_type <> 'purchase' THEN hi WHEN lo <= least(hi, 199) THEN least(hi, 199) END AS nh,
CASE WHEN event_type = 'purchase' AND greatest(lo, 200) <= hi THEN greatest(lo, 200) END AS fl, CASE WHEN event_type = 'purchase' AND greatest(lo, 200) <= hi THEN hi END AS fh FROM (
SELECT o.*, event_type, CASE WHEN l0 IS NULL THEN NULL WHEN event_type = 'signup' THEN c WHEN event_type = 'click' THEN l0 + 10 WHEN event_type = 'error' THEN '-Infinity'::DOUBLE ELSE l0 END AS lo, CASE WHEN l0 IS NULL THEN NULL WHEN event_type = 'signup' THEN c WHEN event_type = 'click' THEN h0 + 10 WHEN event_type = 'error' THEN 'Infinity'::DOUBLE ELSE h0 END AS hi FROM o JOIN b ON b.f = o.f AND b.k = o.k) y) z JOIN n ON n.f = z.f WHERE z.k < last)
SELECT o.f AS func_id, CAST(o.k AS INTEGER) AS block, CASE WHEN l0 >= 0 AND h0 < 250 THEN 'safe' WHEN h0 < 0 OR l0 >= 250 THEN 'out_of_bounds' ELSE 'unknown' END AS verdict FROM o JOIN b ON b.f = o.f AND b.k = o.k WHERE event_type = 'view' AND l0 IS NOT NULL
""")
def index_safety_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether indices lie within their arrays, over branches on bounds."""
    rows = blocks(spark, sf_dir)
    cfg = edges(rows, F.col("event_type") == "purchase", F.lit(False), ("lt", 200))
    insts = steps(rows, {"signup": ("const", True, False), "click": ("add", True, True), "error": ("call", True, False), "view": ("index", False, True)}, {"signup": F.floor("value"), "click": F.lit(10), "view": F.lit(250)})
    return dataflow.index_safety(insts, cfg).select("func_id", "block", "verdict")
