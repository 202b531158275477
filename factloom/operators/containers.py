"""Collections that stay within a block, replayed call by call: which element a read gives, instead of any that was put in.

A collection counts if one constructor that copies nothing makes it, all uses of it and of its copies are calls on it in the
same block, after the constructor, and every index or key is known. All else keeps the general models of containers, so flows
are only lost that can't happen. Whether a collection counts is an aggregate over its uses. Maps are windows by key; lists,
whose indices move, are replayed in order as rows stream by, and only one list's elements and reads are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators import heap
from factloom.session import ship, written

#: The types that are known, and what their methods do by number of arguments.
LISTS = ("java.util.ArrayList", "java.util.LinkedList", "java.util.Vector")
MAPS = ("java.util.HashMap", "java.util.LinkedHashMap", "java.util.TreeMap", "java.util.Hashtable")
LIST_METHODS = {
    "append": ["add/1", "addLast/1", "offer/1", "offerLast/1"], "prepend": ["addFirst/1", "push/1", "offerFirst/1"], "insert": ["add/2"], "set": ["set/2"], "get": ["get/1"], "remove": ["remove/1"],
    "first": ["getFirst/0", "peek/0", "peekFirst/0", "element/0"], "last": ["getLast/0", "peekLast/0"], "take_first": ["removeFirst/0", "poll/0", "pollFirst/0", "pop/0"], "take_last": ["removeLast/0", "pollLast/0"], "ask": ["size/0", "isEmpty/0"], "clear": ["clear/0"],
}
MAP_METHODS = {"put": ["put/2"], "put_absent": ["putIfAbsent/2"], "get": ["get/1"], "get_or": ["getOrDefault/2"], "remove": ["remove/1"], "ask": ["containsKey/1", "size/0", "isEmpty/0"], "clear": ["clear/0"]}
#: Those whose first argument has to be a known index or key.
KEYED_LIST, KEYED_MAP = ("insert", "set", "get", "remove"), ("put", "put_absent", "get", "get_or", "remove")
ARGS = "array<struct<value: bigint, literal: string, whole: boolean>>"


def _action(methods: dict[str, list[str]]) -> Column:
    name = F.concat_ws("/", "method", F.size("args").cast("string"))
    return F.coalesce(*(F.when(name.isin(*names), F.lit(action)) for action, names in methods.items()))


def local_collections(makers: DataFrame, uses: DataFrame, copies: DataFrame) -> DataFrame:
    """The uses of collections that count, as (func, root, pos, is_list, action, key, element, other, result).

    makers(func, block, pos, value, type, args): constructor calls; uses(func, block, pos, value, role, method, args, result):
    all that is done with values, role 'receiver' for calls on them (the constructor's own isn't among them); copies(func,
    dst, src); args as ARGS, `whole` for numbers that can be an index."""
    roots = written(heap.alias_roots(copies), "roots")
    rooted = lambda rows: rows.join(roots, ["func", "value"], "left").withColumn("root", F.coalesce("root", "value"))
    arg = lambda k: F.get("args", F.lit(k))
    plain = (F.size("args") == 0) | (F.size("args") == 1) & F.coalesce(arg(0)["whole"] & arg(0)["literal"].isNotNull(), F.lit(False))
    made = rooted(makers.where(F.col("type").isin(*LISTS, *MAPS)))
    made = made.groupBy("func", "root").agg(F.count("*").alias("n"), F.bool_and(plain).alias("plain"), F.first("block").alias("block"), F.max("pos").alias("made"), F.first(F.col("type").isin(*LISTS)).alias("is_list"))
    made = made.where("n = 1 and plain").drop("n", "plain")
    met = rooted(uses).withColumnRenamed("block", "at_block").join(made, ["func", "root"])
    action = F.when(F.col("is_list"), _action(LIST_METHODS)).otherwise(_action(MAP_METHODS))
    met = met.withColumn("action", action)
    keyed = F.when(F.col("is_list"), F.col("action").isin(*KEYED_LIST)).otherwise(F.col("action").isin(*KEYED_MAP))
    index = arg(0)["literal"].rlike(r"^\d{1,9}$") & arg(0)["whole"]
    known = ~keyed | F.when(F.col("is_list"), index).otherwise(arg(0)["literal"].isNotNull())
    fits = (F.col("role") == "receiver") & F.col("action").isNotNull() & (F.col("at_block") == F.col("block")) & (F.col("pos") > F.col("made")) & known
    met = written(met.withColumn("fits", F.coalesce(fits, F.lit(False))).withColumn("keyed", F.coalesce(keyed, F.lit(False))), "uses")
    good = met.groupBy("func", "root").agg(F.bool_and("fits").alias("good")).where("good").drop("good")
    element = F.when(F.col("keyed"), arg(1)).otherwise(arg(0))["value"]
    return met.join(good, ["func", "root"], "left_semi").select("func", "root", "pos", "is_list", "action", F.when(F.col("keyed"), arg(0)["literal"]).alias("key"), element.alias("element"), "result")


def map_reads(rows: DataFrame) -> DataFrame:
    """(func, root, pos, result, element) of the maps among local_collections(): the element that each call gives, null where
    the key isn't there. What was put before the last clear() doesn't count; putIfAbsent puts where the last change of the
    key before it was none or a removal."""
    whole = Window.partitionBy("func", "root").orderBy("pos")
    eras = rows.where("not is_list").withColumn("era", F.sum((F.col("action") == "clear").cast("int")).over(whole))
    before = Window.partitionBy("func", "root", "era", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("action").isin("put", "put_absent", "remove"), F.col("action"))
    there = F.coalesce(F.last(change, ignorenulls=True).over(before) != "remove", F.lit(False))
    told = eras.where("key is not null").withColumn("there", there)
    puts = (F.col("action") == "put") | (F.col("action") == "put_absent") & ~F.col("there")
    held = F.last(F.when(puts, F.col("element")), ignorenulls=True).over(before)
    gives = F.when(F.col("there"), held).when(F.col("action") == "get_or", F.col("element"))
    silent = eras.where("key is null").withColumn("gives", F.lit(None).cast("long"))
    return told.withColumn("gives", gives).unionByName(silent, allowMissingColumns=True).select("func", "root", "pos", "result", F.col("gives").alias("element"))


def _step(held: list[int], action: str, key: int, element: int) -> int | None:
    """What one call on a list gives; held is changed. IndexError where the index can't be there."""
    if action in ("set", "insert") and key > len(held) - (action == "set"):
        raise IndexError(key)
    if action == "append":
        held.append(element)
    elif action in ("prepend", "insert"):
        held.insert(key if action == "insert" else 0, element)
    elif action == "set":
        old, held[key] = held[key], element
        return old
    elif action == "clear":
        held.clear()
    elif action != "ask":
        place = {"first": 0, "take_first": 0, "last": len(held) - 1, "take_last": len(held) - 1}.get(action, key)
        if 0 <= place < len(held):
            return held.pop(place) if action in ("remove", "take_first", "take_last") else held[place]
    return None


def list_reads(rows: DataFrame) -> DataFrame:
    """(func, root, pos, result, element) of the lists among local_collections(), as map_reads(). A list of which a call writes
    to an index that isn't there gives no rows at all."""
    ship(rows.sparkSession)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["func", "root", "pos", "element"]
        at, held, out, good = None, [], [], True
        for frame in batches:
            done = []
            for r in frame.itertuples(index=False):
                if (r.func, r.root) != at:
                    done += out if good else []
                    at, held, out, good = (r.func, r.root), [], [], True
                if good:
                    try:
                        out.append((*at, r.pos, _step(held, r.action, r.key, r.element)))
                    except IndexError:
                        good, out, held = False, [], []
            yield pd.DataFrame(done, columns=names).astype({"element": "Int64"})
        yield pd.DataFrame(out if good else [], columns=names).astype({"element": "Int64"})

    lists = rows.where("is_list").select("func", "root", "pos", "action", F.coalesce(F.col("key").cast("long"), F.lit(-1)).alias("key"), F.coalesce("element", F.lit(-1).cast("long")).alias("element"))
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("func", "root", "pos")}
    sorted_ = lists.repartition("func", "root").sortWithinPartitions("func", "root", "pos")
    found = sorted_.mapInPandas(replay, ", ".join(f"{c} {t}" for c, t in kind.items()) + ", element long")
    return found.join(rows.where("is_list").select("func", "root", "pos", "result"), ["func", "root", "pos"]).select("func", "root", "pos", "result", "element")


def replayed(makers: DataFrame, uses: DataFrame, copies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(func, pos, element, result): exactly the elements that flow to the results of calls on collections that count; and
    (func, pos) of all calls on these, for which no general model must be used (refined())."""
    rows = written(local_collections(makers, uses, copies), "collections")
    reads = written(map_reads(rows).unionByName(list_reads(rows)), "reads")
    return reads.where("result is not null and element is not null").select("func", "pos", "element", "result"), reads.select("func", "pos")


def refined(flows: DataFrame, reads: DataFrame, exact: DataFrame) -> DataFrame:
    """General flows(func, pos, src, dst) of container calls, but for calls that are replayed, which have the flows of reads."""
    return flows.join(exact, ["func", "pos"], "left_anti").unionByName(reads.select("func", "pos", F.col("element").alias("src"), F.col("result").alias("dst")))
