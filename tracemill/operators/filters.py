"""Case and event filters; each returns a new log."""

from __future__ import annotations

from dataclasses import dataclass
import re
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import BY_NAME, Classifier, EventLog
from .ranges import with_sum_before
from .variants import sequences


def time_frame(log: EventLog, start: datetime | str, end: datetime | str, mode: str = "contained") -> EventLog:
    """Cases whose span over all their events is contained in, started in, or intersects [start, end]; an end without a time is that whole day."""
    span = log.events.groupBy("case_id").agg(F.min("ts").alias("low"), F.max("ts").alias("high"))
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    if isinstance(end, str) and re.fullmatch(r"\s*\d{4}-\d{2}-\d{2}\s*", end) or isinstance(end, date) and not isinstance(end, datetime):
        b = b + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    test = {
        "contained": (F.col("low") >= a) & (F.col("high") <= b),
        "started": (F.col("low") >= a) & (F.col("low") <= b),
        "intersecting": (F.col("low") <= b) & (F.col("high") >= a),
    }[mode]
    return log.keep_cases(span.filter(test))


def _sequence_filter(log: EventLog, test: Column, classifier: Classifier) -> EventLog:
    return log.keep_cases(sequences(log, classifier).filter(test))


def start_activities(log: EventLog, allowed: list[str], classifier: Classifier = BY_NAME) -> EventLog:
    return _sequence_filter(log, F.get("variant", F.lit(0)).isin(allowed), classifier)


def end_activities(log: EventLog, allowed: list[str], classifier: Classifier = BY_NAME) -> EventLog:
    return _sequence_filter(log, F.try_element_at("variant", F.lit(-1)).isin(allowed), classifier)


def keep_activities(log: EventLog, labels: list[str], classifier: Classifier = BY_NAME) -> EventLog:
    """Projection on the labels, of skipped events too; a case stays if an accepted event remains."""
    events = log.events.filter(classifier.label().isin(labels))
    kept = events.groupBy("case_id").agg(F.bool_or(classifier.accepts()).alias("ok")).filter("ok")
    own = W.partitionBy("case_id").orderBy("pos")
    return log.with_events(events.withColumn("pos", F.row_number().over(own) - 1)).keep_cases(kept)


def mandatory_activities(log: EventLog, labels: list[str], classifier: Classifier = BY_NAME) -> EventLog:
    return log.keep_cases(log.events.filter(classifier.accepts() & classifier.label().isin(labels)))


def forbidden_activities(log: EventLog, labels: list[str], classifier: Classifier = BY_NAME) -> EventLog:
    bad = log.events.filter(classifier.accepts() & classifier.label().isin(labels)).select("case_id").distinct()
    return log.keep_cases(log.cases.join(bad, "case_id", "left_anti"))


def case_length(log: EventLog, least: int = 0, most: int | None = None, classifier: Classifier = BY_NAME) -> EventLog:
    test = F.size("variant") >= least
    return _sequence_filter(log, test & (F.size("variant") <= most) if most is not None else test, classifier)


def top_variants(table: DataFrame, count: int | None = None, coverage: float | None = None) -> DataFrame:
    """The most frequent variants, ties by first appearance: ``count`` of them, or the fewest that cover ``coverage`` per cent of the cases (one at least).

    Cases are summed over ranges of the ordered table, so that no task holds all variants.
    """
    if count is not None:
        return table.orderBy(F.desc("n"), "first").limit(max(0, count))
    needed = F.lit(min(100.0, max(0.0, coverage)) / 100)
    total = table.agg(F.sum("n").alias("total_"))
    placed = with_sum_before(table, [F.desc("n"), F.col("first"), F.col("variant")], "n", "covered_").crossJoin(F.broadcast(total))  # one row
    return placed.filter((F.col("covered_") < needed * F.col("total_")) | (F.col("covered_") == 0)).select(table.columns)


def filter_variants(log: EventLog, count: int | None = None, coverage: float | None = None, classifier: Classifier = BY_NAME) -> EventLog:
    rows = sequences(log, classifier)
    table = rows.groupBy("variant").agg(F.count("*").alias("n"), F.min("first").alias("first"))
    return log.keep_cases(rows.join(top_variants(table, count, coverage).select("variant"), "variant", "left_semi"))


@dataclass(frozen=True)
class FilterSettings:
    start: datetime | str | None = None
    end: datetime | str | None = None
    mode: str = "contained"
    starts: tuple[str, ...] = ()
    ends: tuple[str, ...] = ()
    activities: tuple[str, ...] = ()
    activity_mode: str = "keep"
    least: int | None = None
    most: int | None = None
    top: int | None = None
    coverage: float | None = None


def apply_filters(log: EventLog, s: FilterSettings, classifier: Classifier = BY_NAME) -> EventLog:
    """Time, start, end, activities, length, variants, in this order; variants count on what the others left."""
    if s.start is not None or s.end is not None:
        log = time_frame(log, s.start or "0001-01-01", s.end or "9999-12-31", s.mode).noted(f"time frame {s.mode} {s.start} to {s.end}")
    if s.starts:
        log = start_activities(log, list(s.starts), classifier).noted(f"starts with {', '.join(s.starts)}")
    if s.ends:
        log = end_activities(log, list(s.ends), classifier).noted(f"ends with {', '.join(s.ends)}")
    if s.activities:
        kind = {"keep": keep_activities, "mandatory": mandatory_activities, "forbidden": forbidden_activities}[s.activity_mode]
        log = kind(log, list(s.activities), classifier).noted(f"{s.activity_mode} {', '.join(s.activities)}")
    if s.least is not None or s.most is not None:
        log = case_length(log, s.least or 0, s.most, classifier).noted(f"length {s.least} to {s.most}")
    if s.top is not None or s.coverage is not None:
        log = filter_variants(log, s.top, None if s.top is not None else s.coverage, classifier).noted("top variants")
    return log


def search_cases(log: EventLog, text: str) -> EventLog:
    return log.keep_cases(log.cases.filter(F.lower("case_id").contains(text.lower())))
