"""Row-level merges, ranks and comparisons: last and first wins, names, visibility, snapshots, pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows of a key the one that comes last in order; it keeps its (late) place."""
    return _one(rows, [key], F.max_by, order)


def first_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of the rows with equal keys the one that comes first in order."""
    return _one(rows, keys, F.min_by, order)


def _one(rows: DataFrame, keys: list[str], pick, order: str) -> DataFrame:
    # an aggregate rather than a window: it combines before the shuffle, so a hot key moves one row a task
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("__row")).select(*(c if c in keys else F.col(f"__row.{c}").alias(c) for c in rows.columns))


def unique_names(rows: DataFrame, simple: str, values: list[str]) -> DataFrame:
    """(simple, values): the rows whose simple name belongs to no other row."""
    return rows.groupBy(simple).agg(F.count("*").alias("__n"), *(F.min(v).alias(v) for v in values)).where("__n = 1").drop("__n")


def stable_groups(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, n, first): counts, with the place at which a group first occurs, to sort by."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(order).alias("first"))


def visible_before(cell: str, order: str, value: Column) -> Column:
    """The last value that isn't NULL among the earlier rows of the same cell."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(cell).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))


def snapshot_plan(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, status): reused, reparsed, added or removed between two snapshots (key, digest)."""
    here = lambda rows, name: rows.select(key, F.struct(F.col(digest).alias("d")).alias(name))  # noqa: E731  a row without digest is there too
    a, b = here(old, "__old"), here(new, "__new")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(F.col("__old.d") == F.col("__new.d"), "reused").otherwise("reparsed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def compare_findings(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """(keys, side): both, only_left or only_right. One aggregation of flags by key, no join."""
    flags = left.select(*keys, F.lit(True).alias("__l"), F.lit(False).alias("__r")).unionByName(right.select(*keys, F.lit(False).alias("__l"), F.lit(True).alias("__r")))
    side = F.when(F.bool_or("__l") & F.bool_or("__r"), "both").when(F.bool_or("__l"), "only_left").otherwise("only_right")
    return flags.groupBy(*keys).agg(side.alias("side"))


def covered(rows: DataFrame, by: DataFrame, key: str) -> DataFrame:
    """rows with whether by(key) has their key; by may repeat keys."""
    known = by.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__known", F.lit(True))
    return rows.join(known, key, "left").withColumn("covered", F.coalesce("__known", F.lit(False))).drop("__known")


def shown(items: Column, limit: int) -> Column:
    """The first items of a list, as reports show them."""
    return F.slice(items, 1, limit)


def ranked(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """rows with their place among the rows of their keys, up to `limit` (ties share a place). The limit is known to the
    window, so every task drops what can't be among the first before rows are shuffled."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= limit)


def prefixes(path: Column, separator: str = "/") -> Column:
    """All ancestors of a path and the path itself, shortest first; empty parts are dropped."""
    parts = F.filter(F.split(path, separator), lambda p: p != "")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), separator))
    return F.when(F.size(parts) > 0, every).otherwise(F.array().cast("array<string>"))


def islands(rows: DataFrame, key: str, lower: str, upper: str) -> DataFrame:
    """(key, lower, upper, n): the union of overlapping or touching [lower, upper] intervals of each key. NULL bounds are
    unbounded."""
    by_start = Window.partitionBy(key).orderBy(F.col(lower).asc_nulls_first(), F.col(upper).asc_nulls_first())
    before = by_start.rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.max(F.col(upper).isNull()).over(before), F.lit(False))
    furthest = F.max(upper).over(before)
    new = F.when(F.row_number().over(by_start) == 1, 1).when(open_before | F.col(lower).isNull() | (F.col(lower) <= furthest), 0).otherwise(1)
    marked = rows.withColumn("__new", new).withColumn("__island", F.sum("__new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    open_low, open_high = F.max(F.col(lower).isNull()), F.max(F.col(upper).isNull())
    out = marked.groupBy(key, "__island").agg(F.when(~open_low, F.min(lower)).alias(lower), F.when(~open_high, F.max(upper)).alias(upper), F.count("*").alias("n"))
    return out.select(key, lower, upper, "n")


def in_range(value: Column, lo: Column, lo_incl: Column, hi: Column, hi_incl: Column) -> Column:
    """value in the interval; NULL ends are unbounded."""
    above = lo.isNull() | F.when(lo_incl, value >= lo).otherwise(value > lo)
    below = hi.isNull() | F.when(hi_incl, value <= hi).otherwise(value < hi)
    return above & below


def confusion(rows: DataFrame, keys: list[str], actual: Column, predicted: Column, beta: float = 1.0) -> DataFrame:
    """Counts and rates by group; a rate whose denominator is 0 is NULL."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = rows.groupBy(*keys).agg(count(actual & predicted).alias("tp"), count(~actual & predicted).alias("fp"), count(actual & ~predicted).alias("fn"), count(~actual & ~predicted).alias("tn"))
    rate = lambda a, b: F.col(a) / F.nullif(F.col(a) + F.col(b), F.lit(0))
    out = out.withColumns({"precision": rate("tp", "fp"), "recall": rate("tp", "fn"), "fpr": rate("fp", "tn")})
    b2 = beta * beta
    f = (1 + b2) * F.col("precision") * F.col("recall") / F.nullif(b2 * F.col("precision") + F.col("recall"), F.lit(0.0))
    return out.withColumns({"f_beta": f, "youden": F.col("recall") - F.col("fpr")})
