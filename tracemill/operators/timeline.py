"""Windows over time: positions on time axes, ranks of rows and colours, batches, gaps and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import natural_order
from ..log import BY_NAME, Classifier, EventLog, seconds
from .ranges import runs, with_neighbours, with_rank, with_sum_before
from .variants import labelled

# Seconds of the units of a time axis; months have 30 days, years 365.
AXIS_UNITS = {"s": 1, "min": 60, "h": 3600, "d": 86400, "wk": 604800, "mo": 2592000, "y": 31536000}


def actual_time(log: EventLog, unit: str = "s") -> DataFrame:
    """x: time since the first event of the log."""
    origin = log.events.agg(F.min("ts").alias("origin"))
    return log.events.crossJoin(F.broadcast(origin)).withColumn("x", seconds("origin", "ts") / AXIS_UNITS[unit]).drop("origin")  # one row


def case_time(log: EventLog, relative: bool = False, classifier: Classifier = BY_NAME) -> DataFrame:
    """x: time since the case's start, or per cent of its duration (0 if that is 0), over the accepted events."""
    own = W.partitionBy("case_id")
    rows = labelled(log, classifier).withColumns({"low": F.min("ts").over(own), "high": F.max("ts").over(own)})
    since, span = seconds("low", "ts"), seconds("low", "high")
    return rows.withColumn("x", F.when(span == 0, F.lit(0.0)).otherwise(since / span * 100) if relative else since).drop("low", "high")


def global_order(log: EventLog) -> DataFrame:
    """x: rank in the whole log by (time, case, position), undated events first."""
    ordered = log.events.join(log.cases.select("case_id", "first"), "case_id")
    return with_rank(ordered, [F.col("ts").asc_nulls_first(), F.col("first"), F.col("case_id"), F.col("pos")], "x").drop("first")


def case_position(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """x: place among the case's accepted events."""
    return labelled(log, classifier).withColumnRenamed("at", "x")


def ranked_rows(log: EventLog, by: str, sort: str = "first", descending: bool = False) -> DataFrame:
    """row, place: the values of column ``by`` in order of first or last time, duration, count, or natural name."""
    rows = log.events.withColumn("row", F.coalesce(F.col(by).cast("string"), F.lit(""))).groupBy("row").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("count"))
    rows = rows.withColumn("duration", seconds("first", "last"))
    keys = natural_order(F.col("row")) if sort == "name" else [F.col(sort)]
    keys = [k.desc() if descending else k.asc() for k in keys]
    return with_rank(rows, [*keys, *natural_order(F.col("row"))], "place")


def frequency_ranks(logs: dict[str, EventLog], column: str = "activity", distinct: int = 8) -> DataFrame:
    """value, n, rank, slot: ranks by frequency over all logs; from ``distinct`` on all share the last slot."""
    counts = None
    for log in logs.values():
        one = log.events.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
        counts = one if counts is None else counts.unionByName(one)
    total = counts.groupBy("value").agg(F.sum("n").alias("n"))
    ranked = with_rank(total, [F.desc("n"), F.col("value")], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))
    return ranked.withColumn("slot", F.least("rank", F.lit(distinct + 1)))


def timeline_statistics(log: EventLog) -> DataFrame:
    """One row: events, cases, and durations of cases with over one timed event; the median is the upper middle one."""
    spans = log.events.groupBy("case_id").agg(F.count("*").alias("events"), F.count("ts").alias("timed"), seconds(F.min("ts"), F.max("ts")).alias("d"))
    timed = spans.filter("timed > 1")
    middle = timed.agg(F.count("*").alias("m"))
    ranked = with_sum_before(timed.groupBy("d").agg(F.count("*").alias("k")), [F.col("d")], "k", "above")
    median = ranked.crossJoin(F.broadcast(middle)).filter("above + k > m div 2").agg(F.min("d").alias("median_duration"))
    return spans.agg(F.sum("events").alias("events"), F.count("*").alias("cases")).crossJoin(timed.agg(F.avg("d").alias("mean_duration"), F.min("d").alias("shortest"), F.max("d").alias("longest"))).crossJoin(median)


def batches(log: EventLog, activity: str, gap_seconds: int = 3600) -> DataFrame:
    """start, end, n: runs of an activity over the whole log; a gap longer than ``gap_seconds`` begins a new one."""
    rows = log.events.filter((F.col("activity") == activity) & F.col("ts").isNotNull()).groupBy(F.unix_micros("ts").alias("us")).agg(F.count("*").alias("n"))
    found = runs(rows, "us", F.lit(gap_seconds * 1_000_000), "n")
    return found.select(F.timestamp_micros("first").alias("start"), F.timestamp_micros("last").alias("end"), "n")


def weekend_events(log: EventLog, offset: str | None = None) -> DataFrame:
    """Number of events on Saturdays and Sundays of their own UTC offset (column ``offset`` in minutes)."""
    local = F.col("ts") if offset is None else F.timestamp_add("MINUTE", F.col(offset), F.col("ts"))
    return log.events.agg(F.count_if(F.dayofweek(local).isin(1, 7)).alias("weekend_events"))


def timeouts(log: EventLog, longer_than: float) -> DataFrame:
    """Number of cases with over ``longer_than`` seconds between events that follow each other in time."""
    near = with_neighbours(log.events.filter("ts is not null").select("case_id", "ts"), ["case_id"], [F.col("ts")], {"last": "ts"}, {})
    gaps = near.withColumn("gap", seconds("last", "ts"))
    return gaps.agg(F.count_distinct(F.when(F.col("gap") > longer_than, F.col("case_id"))).alias("cases"))


def arrival_rate(log: EventLog) -> DataFrame:
    """Cases per day between the first and the last case start, which count as one day at least."""
    starts = log.events.groupBy("case_id").agg(F.min("ts").alias("start")).filter("start is not null")
    return starts.agg((F.count("*") / F.greatest(seconds(F.min("start"), F.max("start")) / 86400, F.lit(1.0))).alias("cases_per_day"))
