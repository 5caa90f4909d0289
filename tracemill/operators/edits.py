"""Bulk edits of a log."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import EventLog


def rename_activity(log: EventLog, old: str, new: str) -> EventLog:
    return log.with_events(log.events.withColumn("activity", F.when(F.col("activity") == old, F.lit(new)).otherwise(F.col("activity"))))


def remove_activity(log: EventLog, name: str) -> EventLog:
    """Deletes the activity's events; cases stay, empty ones too."""
    return log.with_events(renumber(log.events.filter(~F.col("activity").eqNullSafe(name))))


def renumber(events: DataFrame) -> DataFrame:
    return events.withColumn("pos", F.row_number().over(W.partitionBy("case_id").orderBy("pos")) - 1)


def delete_cases(log: EventLog, ids: DataFrame) -> EventLog:
    return replace(log, cases=log.cases.join(ids, "case_id", "left_anti"), events=log.events.join(ids, "case_id", "left_anti"))


def rename_cases(log: EventLog, names: DataFrame) -> EventLog:
    """names: case_id, new_id."""
    new = lambda df: df.join(names, "case_id", "left").withColumn("case_id", F.coalesce("new_id", "case_id")).drop("new_id")
    return replace(log, cases=new(log.cases), events=new(log.events))


def duplicate_cases(log: EventLog, names: DataFrame) -> EventLog:
    """Adds a copy under new_id of every case in names (case_id, new_id)."""
    copy = lambda df: df.join(names, "case_id").withColumn("case_id", F.col("new_id")).drop("new_id").select(df.columns)
    return replace(log, cases=log.cases.unionByName(copy(log.cases)), events=log.events.unionByName(copy(log.events)))


def add_cases(log: EventLog, cases: DataFrame) -> EventLog:
    return replace(log, cases=log.cases.unionByName(cases, allowMissingColumns=True))


def set_events(log: EventLog, changes: DataFrame) -> EventLog:
    """changes: case_id, pos and the columns to overwrite; null leaves a value as it is."""
    names = [c for c in changes.columns if c not in ("case_id", "pos")]
    new = changes.select("case_id", "pos", *(F.col(c).alias(f"new_{c}") for c in names))
    out = log.events.join(new, ["case_id", "pos"], "left")
    return log.with_events(out.withColumns({c: F.coalesce(f"new_{c}", c) for c in names}).select(log.events.columns))


def insert_events(log: EventLog, rows: DataFrame) -> EventLog:
    """rows: case_id, pos (the new event stands before the event that has it) and event columns."""
    old = log.events.withColumn("after_", F.lit(1))
    new = rows.withColumn("after_", F.lit(0))
    both = old.unionByName(new, allowMissingColumns=True)
    order = W.partitionBy("case_id").orderBy("pos", "after_")
    return log.with_events(both.withColumn("pos", F.row_number().over(order) - 1).drop("after_"))


def delete_events(log: EventLog, places: DataFrame) -> EventLog:
    return log.with_events(renumber(log.events.join(places, ["case_id", "pos"], "left_anti")))


def swap_events(log: EventLog, places: DataFrame) -> EventLog:
    """places: case_id, pos; the event there changes places with the one after it."""
    moves = places.select("case_id", "pos", (F.col("pos") + 1).alias("to")).unionByName(places.select("case_id", (F.col("pos") + 1).alias("pos"), F.col("pos").alias("to")))
    sizes = log.events.groupBy("case_id").agg((F.max("pos")).alias("last"))
    moves = moves.join(sizes, "case_id").filter("to <= last and pos <= last").drop("last")
    out = log.events.join(moves, ["case_id", "pos"], "left").withColumn("pos", F.coalesce("to", "pos")).drop("to")
    return log.with_events(out.select(log.events.columns))


def is_plain(log: EventLog) -> DataFrame:
    """One row: whether events hold nothing but activity names."""
    other = [c for c in log.events.columns if c not in ("case_id", "pos", "activity")]
    plain = F.lit(True)
    for c in other:
        plain = plain & F.col(c).isNull()
    return log.events.agg(F.coalesce(F.bool_and(plain), F.lit(True)).alias("plain"))
