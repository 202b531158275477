"""Checkers: registered functions over event frames, checked on the way in and out, contained when they fail."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import written

#: The events of each kind of checker.
EVENTS = {"frontend": {"file", "import", "function", "call"}, "unified_dataflow": {"file", "import", "function", "call", "flow", "taint", "summary", "end"}}
FINDING_DDL = "rule_id string, message string, path string, line int, col int"


@dataclass
class Checker:
    """rules: the ids it may report; events: what it subscribes to; run: event frame -> findings."""

    id: str
    kind: str
    rules: frozenset[str]
    events: frozenset[str]
    run: Callable[[DataFrame], DataFrame]
    problems: list[str] = field(default_factory=list)

    def __post_init__(self):
        if self.kind not in EVENTS:
            raise ValueError(f"no kind of checker {self.kind!r}")
        every = set().union(*EVENTS.values())
        for e in self.events:
            if e not in every:
                raise ValueError(f"no event {e!r}")
            if e not in EVENTS[self.kind]:
                raise ValueError(f"a {self.kind} checker can't subscribe to {e!r}")


@contextlib.contextmanager
def _stopped_after(spark: SparkSession, seconds: float | None):
    """Jobs that are begun within are cancelled after so many seconds."""
    if seconds is None:
        yield
        return
    tag = f"checker-{uuid.uuid4().hex}"
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobsWithTag, [tag])
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def run_all(spark: SparkSession, checkers: list[Checker], events: DataFrame, fail_fast: bool = False, seconds: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings with checker_id, diagnostics(checker_id, problem)) over events(event, ...). Findings with a rule that isn't
    declared or a place that isn't one-based are dropped and told; a checker that fails, or whose jobs take longer than
    `seconds`, gives a diagnostic. Its rows are written while it is watched, so nothing of it runs later."""
    found = spark.createDataFrame([], "checker_id string, " + FINDING_DDL)
    told: list[tuple[str, str]] = []
    names = [c.split()[0] for c in FINDING_DDL.split(", ")]
    for c in checkers:
        try:
            with _stopped_after(spark, seconds):
                rows = written(c.run(events.where(F.col("event").isin(*c.events))).select(*names), "checker")
            good = F.col("rule_id").isin(*c.rules) & (F.col("line") >= 1) & (F.col("col") >= 1)
            bad = rows.where(~F.coalesce(good, F.lit(False))).count()
        except Exception as error:  # noqa: BLE001  one checker's failure isn't the scan's
            if fail_fast:
                raise
            told.append((c.id, f"failed: {type(error).__name__}"))
            continue
        if bad:
            told.append((c.id, f"{bad} invalid findings"))
        found = found.unionByName(rows.where(good).withColumn("checker_id", F.lit(c.id)))
    return found, spark.createDataFrame(told, "checker_id string, problem string")
