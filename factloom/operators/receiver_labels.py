"""Labels that calls set on the objects they are called on: a factory that is configured, and the parser that it makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.congruence import NotFinished
from factloom.session import written

_AFTER = 2**31 - 1


def _state(probes: DataFrame, events: DataFrame) -> DataFrame:
    """probes(object, pos, step, ...) once for each label that their object has there, as (..., label): the last of
    events(object, label, pos, step, sets) up to a probe sets it. One sorted pass an object and label."""
    labels = events.where("sets").select("object", "label").distinct()
    asked = probes.join(labels, "object")
    both = asked.withColumn("sets", F.lit(None).cast("boolean")).withColumn("probe", F.lit(True)).unionByName(events.withColumn("probe", F.lit(False)), allowMissingColumns=True)
    last = F.last("sets", ignorenulls=True).over(Window.partitionBy("object", "label").orderBy("pos", "step", "probe").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("has", last).where("probe and has").drop("sets", "has", "probe")


def labels_at_calls(calls: DataFrame, transforms: DataFrame, rounds: int = 64) -> DataFrame:
    """(call, label): what labels the receiver has when calls(call, pos, object, result) begin; result is the object that a call
    gives and hands the receiver's labels to, else null. transforms(call, nth, remove, add) are the rules that meet a call on
    its receiver, in their order; one takes away before it adds. Calls are in the order of pos, which no two on one object share.

    Labels only come to results from calls before, and more labels never make fewer, so rounds over the labels that have
    come new end with the least set; each hands labels one object further. NotFinished after `rounds` objects in a row."""
    on = calls.where("object is not null")
    met = transforms.join(on.select("call", "pos", "object"), "call")
    change = lambda column, place, sets: met.select("object", F.explode(F.array_distinct(column)).alias("label"), "pos", (F.col("nth") * 2 + place).alias("step"), F.lit(sets).alias("sets"))
    own = written(change("remove", 0, False).unionByName(change("add", 1, True)), "changes")
    hands = written(on.where("result is not null").select("object", "pos", F.lit(_AFTER - 1).alias("step"), "result"), "hands")
    events, new, fresh = own, None, own.where("sets").select("object", "label").distinct()
    for _ in range(rounds):
        # only objects to which labels have come can hand on more than before
        touched = fresh.select("object").distinct()
        state = _state(hands.join(touched, "object", "left_semi"), events.join(touched, "object", "left_semi"))
        handed = state.select(F.col("result").alias("object"), "label", "pos", F.lit(_AFTER).alias("step"), F.lit(True).alias("sets")).distinct()
        fresh = written(handed if new is None else handed.join(new, ["object", "label", "pos"], "left_anti"), "handed")
        if fresh.isEmpty():
            return _state(on.select("call", "object", "pos", F.lit(-1).alias("step")), events).select("call", "label")
        new = fresh if new is None else new.unionByName(fresh)
        events = own.unionByName(new)
    raise NotFinished(f"labels are handed on to more than {rounds} objects in a row")
