"""Event logs as DataFrames: cases, events and variants."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Classifier:
    """Turns an event into a label: the values of ``keys`` joined with '+'.

    With ``lifecycles``, events of another lifecycle are skipped; events without one are always taken.
    """

    name: str = "name"
    keys: tuple[str, ...] = ("activity",)
    lifecycles: tuple[str, ...] | None = None

    def label(self) -> Column:
        return F.concat_ws("+", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in self.keys))

    def accepts(self) -> Column:
        if self.lifecycles is None:
            return F.lit(True)
        return F.col("lifecycle").isNull() | F.lower("lifecycle").isin([x.lower() for x in self.lifecycles])


BY_NAME = Classifier()
BY_NAME_COMPLETE = Classifier("name (complete)", lifecycles=("complete",))
BY_NAME_LIFECYCLE = Classifier("name + lifecycle", keys=("activity", "lifecycle"))


@dataclass(frozen=True)
class EventLog:
    """``cases`` (case_id, first, ...) and ``events`` (case_id, pos, activity, ts, lifecycle, resource, ...).

    ``first`` orders cases by first appearance. A case without events has a row in ``cases`` only. ``meta``
    holds declared classifiers and notes on how the log came about.
    """

    cases: DataFrame
    events: DataFrame
    meta: dict = field(default_factory=dict)

    def with_events(self, events: DataFrame) -> EventLog:
        return replace(self, events=events)

    def keep_cases(self, ids: DataFrame) -> EventLog:
        """The cases whose case_id is in ``ids``, with all their events."""
        ids = ids.select("case_id").distinct()
        return replace(self, cases=self.cases.join(ids, "case_id", "left_semi"), events=self.events.join(ids, "case_id", "left_semi"))

    def noted(self, note: str) -> EventLog:
        return replace(self, meta=self.meta | {"notes": [*self.meta.get("notes", []), note]})

    def pipe(self, f: Callable, *args, **settings):
        return f(self, *args, **settings)


#: Rows of cases that one task orders, about: a larger table is dealt over more partitions than the session has.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """rows (``size`` of them) by key over as many partitions as hold about TASK_ROWS each; as they are where the session's partitions suffice."""
    n = -(-size // TASK_ROWS)
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def log_from_table(df: DataFrame, case: Column | str | None = None, activity: Column | str = "activity", ts: Column | str | None = None, resource: Column | str | None = None, lifecycle: Column | str | None = None, order_by: Sequence[Column | str] = (), keep: Sequence[str] = (), hot_rows: int | None = None) -> EventLog:
    """Any table as a log.

    The case column is ``case:concept:name`` if it is there and none is given, else the first column. ``order_by``
    fixes the order of a case's events; ties go by label. Rows without a case are dropped. The only exchange is by
    case, and later windows over cases reuse it; rows are counted first, so that its partitions grow in number and not in size.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    if case is None:
        case = "`case:concept:name`" if "case:concept:name" in df.columns else f"`{df.columns[0]}`"
    none = F.lit(None)
    order = [col(c) for c in order_by] or ([col(ts)] if ts is not None else [F.lit(0)])
    rows = df.select(
        col(case).cast("string").alias("case_id"),
        col(activity).cast("string").alias("activity"),
        (col(ts) if ts is not None else none).cast("timestamp").alias("ts"),
        (col(lifecycle) if lifecycle is not None else none).cast("string").alias("lifecycle"),
        (col(resource) if resource is not None else none).cast("string").alias("resource"),
        F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))).alias("order_"),
        *keep,
    ).filter("case_id is not null")
    if hot_rows is None:
        events = dealt(rows, df.count(), "case_id").withColumn("pos", F.row_number().over(W.partitionBy("case_id").orderBy("order_", "activity")) - 1)
    else:
        from .operators.ranges import with_place

        events = with_place(rows, ["case_id"], [F.col("order_"), F.col("activity")], "pos", hot_rows)
    cases = events.groupBy("case_id").agg(F.min("order_").alias("first"))
    return EventLog(cases, events.drop("order_").select("case_id", "pos", "activity", "ts", "lifecycle", "resource", *keep))


def to_table(log: EventLog) -> DataFrame:
    """One row per event, case id first; the case's own columns follow with the prefix ``case:``."""
    own = [c for c in log.cases.columns if c not in ("case_id", "first")]
    cases = log.cases.select("case_id", *(F.col(c).alias(f"case:{c}") for c in own))
    return log.events.join(cases, "case_id") if own else log.events


def seconds(a: Column | str, b: Column | str) -> Column:
    """b - a in seconds, as a double."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return (F.unix_micros(col(b)) - F.unix_micros(col(a))) / 1e6
