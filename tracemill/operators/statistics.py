"""Descriptive statistics of logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import relative_difference
from ..log import BY_NAME, Classifier, EventLog, seconds
from .ranges import quantiles
from .variants import labelled, ranked_variants, sequences, variants


def summarise(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """One row: cases, accepted events, variants, activities, and the first and last time of all events."""
    events = log.events.agg(
        F.count_if(classifier.accepts()).alias("events"),
        F.count_distinct(F.when(classifier.accepts(), classifier.label())).alias("activities"),
        F.min("ts").alias("first_event"),
        F.max("ts").alias("last_event"),
    )
    cases = variants(log, classifier).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.count("*").alias("variants"))
    return cases.crossJoin(events)  # one row each


def variant_table(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    return ranked_variants(variants(log, classifier))


def activity_statistics(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """label, occurrences, cases, as_start, as_end."""
    rows = sequences(log, classifier).select("variant").groupBy("variant").agg(F.count("*").alias("n"))
    each = rows.select("n", F.size("variant").alias("size"), "variant", F.posexplode("variant").alias("at", "label"))
    per = each.groupBy("label").agg(
        F.sum("n").alias("occurrences"),
        F.sum(F.when(F.array_position("variant", F.col("label")) == F.col("at") + 1, F.col("n")).otherwise(0)).alias("cases"),
        F.sum(F.when(F.col("at") == 0, F.col("n")).otherwise(0)).alias("as_start"),
        F.sum(F.when(F.col("at") == F.col("size") - 1, F.col("n")).otherwise(0)).alias("as_end"),
    )
    return per


def events_per_case(log: EventLog, classifier: Classifier = BY_NAME, fill: bool = False) -> DataFrame:
    """length and cases; with ``fill`` also the lengths between that no case has."""
    found = sequences(log, classifier).groupBy(F.size("variant").alias("length")).agg(F.count("*").alias("cases"))
    if not fill:
        return found
    all_ = found.agg(F.explode(F.sequence(F.min("length"), F.max("length"))).alias("length"))
    return all_.join(found, "length", "left").fillna(0, ["cases"])


def case_spans(log: EventLog) -> DataFrame:
    """case_id, events (all), start, end, duration in seconds; cases without times have nulls."""
    spans = log.events.groupBy("case_id").agg(F.count("*").alias("events"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    out = log.cases.select("case_id").join(spans, "case_id", "left").fillna(0, ["events"])
    return out.withColumn("duration", seconds("start", "end"))


def duration_statistics(log: EventLog) -> DataFrame:
    spans = case_spans(log)
    one = spans.agg(F.count("duration").alias("cases"), F.avg("duration").alias("mean"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"))
    middle = quantiles(spans, [], "duration", {"median": 0.5}).agg(F.max("median").alias("median"))
    return one.crossJoin(F.broadcast(middle)).select("cases", "mean", "median", "shortest", "longest")  # one row each


def case_table(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """case_id, events, start, duration, number of its variant."""
    ranks = variant_table(log, classifier).select("variant", F.col("rank").alias("variant_number"))
    numbers = sequences(log, classifier).join(ranks, "variant").select("case_id", "variant_number")
    return case_spans(log).join(numbers, "case_id").select("case_id", "events", "start", "duration", "variant_number")


def key_figures(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """figure and value, one row per figure; times are epoch seconds."""
    table = variants(log, classifier)
    shape = table.agg(
        F.sum("n").alias("cases"), F.count("*").alias("variants"), (100.0 * F.max("n") / F.sum("n")).alias("top variant %"),
        (F.sum(F.size("variant") * F.col("n")) / F.sum("n")).alias("mean length"), F.max(F.size("variant")).alias("longest case"),
    )
    events = log.events.agg(
        F.count_if(classifier.accepts()).alias("events"), F.count_distinct(F.when(classifier.accepts(), classifier.label())).alias("activities"),
        (F.unix_micros(F.min("ts")) / 1e6).alias("first event"), (F.unix_micros(F.max("ts")) / 1e6).alias("last event"), seconds(F.min("ts"), F.max("ts")).alias("span"),
    )
    times = duration_statistics(log).select(F.col("mean").alias("mean duration"), F.col("median").alias("median duration"), F.col("shortest").alias("shortest duration"), F.col("longest").alias("longest duration"))
    one = shape.crossJoin(events).crossJoin(times)  # one row each
    return one.select(*(F.col(f"`{c}`").cast("double").alias(c) for c in one.columns)).unpivot([], [f"`{c}`" for c in one.columns], "figure", "value")


def compare_figures(left: DataFrame, right: DataFrame) -> DataFrame:
    """figure, a, b and their relative difference as text."""
    both = left.select("figure", F.col("value").alias("a")).join(right.select("figure", F.col("value").alias("b")), "figure", "full_outer")
    return both.withColumn("difference", relative_difference(F.col("a"), F.col("b")))


def activity_shares(logs: dict[str, EventLog], classifier: Classifier = BY_NAME) -> DataFrame:
    """label, and per log the share of cases that have it and its events; the largest share first."""
    parts = []
    for name, log in logs.items():
        total = log.cases.agg(F.count("*").alias("total"))
        one = activity_statistics(log, classifier).crossJoin(F.broadcast(total))
        parts.append(one.select("label", F.lit(name).alias("log"), (F.col("cases") / F.col("total")).alias("share"), F.col("occurrences").alias("events")))
    rows = reduce(DataFrame.unionByName, parts)
    wide = rows.groupBy("label").agg(*(f(F.when(F.col("log") == n, F.col(c)).otherwise(0)).alias(f"{c}_{n}") for n in logs for c, f in (("share", F.sum), ("events", F.sum))))
    shares = [F.col(f"share_{n}") for n in logs]
    return wide.withColumn("largest", F.greatest(*shares) if len(shares) > 1 else shares[0]).orderBy(F.desc("largest"), "label")


def variant_shares(logs: dict[str, EventLog], limit: int = 60, classifier: Classifier = BY_NAME) -> DataFrame:
    """The ``limit`` variants with the largest sum of shares over the logs, and the number of distinct variants."""
    parts = []
    for name, log in logs.items():
        table = variants(log, classifier)
        total = table.agg(F.sum("n").alias("total"))
        parts.append(table.crossJoin(F.broadcast(total)).select("variant", F.lit(name).alias("log"), (F.col("n") / F.col("total")).alias("share")))
    wide = reduce(DataFrame.unionByName, parts).groupBy("variant").agg(F.sum("share").alias("sum"), *(F.sum(F.when(F.col("log") == n, F.col("share")).otherwise(0.0)).alias(f"share_{n}") for n in logs))
    total = wide.agg(F.count("*").alias("distinct_variants"))
    return wide.orderBy(F.desc(F.round("sum", 12)), "variant").limit(limit).crossJoin(F.broadcast(total))


def describe_log(log: EventLog) -> DataFrame:
    """measure, count, mean, std, min, quartiles and max of events per case and of durations in hours."""
    spans = case_spans(log).select(F.col("events").cast("double").alias("events per case"), (F.col("duration") / 3600).alias("duration (h)"))
    rows = spans.unpivot([], ["`events per case`", "`duration (h)`"], "measure", "x")
    q = quantiles(rows, ["measure"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    out = rows.groupBy("measure").agg(F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return out.join(F.broadcast(q), "measure", "left").select("measure", "count", "mean", "std", "min", "q25", "q50", "q75", "max")  # two rows


def correlate(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: Pearson correlation of every pair of numeric columns, from one aggregation."""
    if len(columns) < 2:
        raise ValueError("a correlation needs two numeric columns")
    pairs = [(a, b) for a in columns for b in columns]
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    names = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.inline(names))


def activity_sets(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """One row: variants, cases, events, and the sorted sets of activities, start and end activities."""
    table = variants(log, classifier)
    filled = F.size("variant") > 0
    sets = table.agg(
        F.count("*").alias("variants"),
        F.sum("n").alias("cases"),
        F.sum(F.size("variant") * F.col("n")).alias("events"),
        F.array_sort(F.collect_set(F.when(filled, F.get("variant", F.lit(0))))).alias("start_activities"),
        F.array_sort(F.collect_set(F.when(filled, F.try_element_at("variant", F.lit(-1))))).alias("end_activities"),
    )
    names = table.select(F.explode("variant").alias("label")).agg(F.array_sort(F.collect_set("label")).alias("activities"))
    return sets.crossJoin(names)  # one row each


def stack_scores(tables: list[DataFrame]) -> DataFrame:
    """Score rows one under the other; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


__all__ = [name for name, value in list(globals().items()) if callable(value) and getattr(value, "__module__", "") == __name__] + ["labelled"]
