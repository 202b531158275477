"""Aliases and cells: roots of copies, cells of fields, overlap of abstract objects, live values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import graph
from factloom.session import written


def alias_roots(copies: DataFrame) -> DataFrame:
    """(func, value, root): values that copies(func, dst, src) make one, named by the smallest. Functions don't mix."""
    at = lambda c: F.struct(F.col("func"), F.col(c).alias("value"))
    found = graph.components(copies.select(at("src").alias("src"), at("dst").alias("dst")))
    return found.select("node.func", "node.value", F.col("root.value").alias("root"))


def field_edges(stores: DataFrame, loads: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst): values that stores(func, base, field, value) put into a cell and loads(func, base, field, value) take out.
    A cell is a field of an alias root; '*' is a field that isn't known and meets every field of its root."""

    def cells(rows: DataFrame, name: str) -> DataFrame:
        at = rows.join(roots.select("func", F.col("value").alias("base"), "root"), ["func", "base"], "left")
        return at.select("func", F.coalesce("root", "base").alias("root"), F.col("field").alias(f"{name}_field"), F.col("value").alias(name)).distinct()

    s, d = cells(stores, "src"), cells(loads, "dst")
    same = s.withColumn("field", F.col("src_field")).join(d.withColumn("field", F.col("dst_field")), ["func", "root", "field"]).select("func", "src", "dst")
    met = lambda left, right: s.where(f"src_field {left} '*'").join(d.where(f"dst_field {right} '*'"), ["func", "root"]).select("func", "src", "dst")
    return same.unionByName(met("=", "<>")).unionByName(met("<>", "=")).distinct()


#: Pairs that a task of overlaps counts, and cells of one object that stand in one array there.
PAIRS, LOT = 2_000_000, 4096


def overlaps(cells: DataFrame) -> DataFrame:
    """(a, b, shared): cells(cell, object) that share abstract objects, a before b, with the number they share. Cells meet on
    their objects, so cells without a common object are never compared.

    Pairs are counted first, and there are as many tasks as they need: one counts about PAIRS of them, however large the table
    is. Cells move to the task of a cell before them as arrays; of an object with very many cells as several, in several tasks."""
    c = written(cells.select("cell", "object").where("cell is not null and object is not null").distinct(), "cells")
    pairs = c.groupBy("object").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    tasks = int(pairs // PAIRS) + 1
    own = Window.partitionBy("object")
    dealt = c.select("*", F.floor((F.row_number().over(own.orderBy("cell")) - 1) / LOT).alias("lot"), F.floor((F.count("*").over(own) - 1) / LOT).alias("last"))
    lots = dealt.groupBy("object", "lot").agg(F.collect_list("cell").alias("cells")).repartition(tasks, "object", "lot")
    met = dealt.select("object", "cell", F.explode(F.sequence("lot", "last")).alias("lot")).repartition(tasks, "object", "lot").join(lots, ["object", "lot"])
    after = met.select(F.col("cell").alias("a"), F.filter("cells", lambda b: b > F.col("cell")).alias("bs")).where(F.size("bs") > 0)
    return after.repartition(tasks, "a").select("a", F.explode("bs").alias("b")).groupBy("a", "b").agg(F.count("*").alias("shared"))  # no second shuffle


def must_alias(cells: DataFrame) -> DataFrame:
    """(a, b): pairs of cells(cell, object) that hold exactly one object, the same. The cells of an object are chained to its
    smallest, so a group of n gives n - 1 rows: a is the smallest of the group."""
    single = cells.groupBy("cell").agg(F.min("object").alias("object"), F.max("object").alias("high")).where("object = high").select("cell", "object")
    first = single.groupBy("object").agg(F.min("cell").alias("a"))
    return single.join(first, "object").where("cell <> a").select("a", F.col("cell").alias("b"))


def live_state(stores: DataFrame) -> DataFrame:
    """(cell, values): the distinct values that stores(cell, value) put into each cell, sorted."""
    return stores.groupBy("cell").agg(F.array_sort(F.collect_set("value")).alias("values"))


def catalog(seeds: DataFrame, column: str) -> DataFrame:
    """(column, object): numbers from 1 for the distinct seeds in their order. Seeds are dealt by range and numbered within
    their range; only the sizes of the ranges are summed up in one place."""
    dealt = written(seeds.select(column).where(F.col(column).isNotNull()).distinct().repartitionByRange(column).withColumn("__range", F.spark_partition_id()), "catalog")
    sizes = dealt.groupBy("__range").agg(F.count("*").alias("n"), F.min(column).alias("low"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(column))
    return dealt.withColumn("nth", nth).join(sizes.select("__range", before.alias("before")), "__range").select(column, (F.col("before") + F.col("nth")).alias("object"))


def regions_related(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of left(a) and right(b): memory regions that are equal or of which one holds the other, as `r` holds `r.f` and
    `r[0]`. Regions meet on exploded ancestors."""

    def ancestors(c: str):
        parts = F.regexp_extract_all(F.col(c), F.lit(r"^[^.\[]+|\.[^.\[]+|\[[^\]]*\]"), 0)
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), ""))

    a, b = left.select("a").distinct(), right.select("b").distinct()
    down = a.select("a", F.explode(ancestors("a")).alias("b")).join(b, "b")
    up = b.select("b", F.explode(ancestors("b")).alias("a")).join(a, "a").select("a", "b")
    return down.select("a", "b").unionByName(up).distinct()
