"""Logs as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import parse_timestamp, utc_offset_minutes
from ..log import EventLog, to_table

# Header names that are taken for each role, the first one found wins; case does not matter.
ROLES = {
    "case": ("case:concept:name", "case id", "case_id", "caseid", "case", "trace", "trace id"),
    "activity": ("concept:name", "activity", "activity name", "event", "task", "action"),
    "ts": ("time:timestamp", "timestamp", "time", "complete timestamp", "date", "start timestamp"),
    "resource": ("org:resource", "resource", "user", "role"),
    "lifecycle": ("lifecycle:transition", "lifecycle", "transition"),
}
# Bytes 0x80 to 0x9F as Latin-1 and as windows-1252 reads them; five of them have no letter there.
CP1252 = tuple(zip(*((chr(b), c) for b in range(0x80, 0xA0) if (c := bytes([b]).decode("cp1252", "ignore")))))
CP1252 = ("".join(CP1252[0]), "".join(CP1252[1]))
DELIMITERS = (",", ";", "\t", "|")


def sniff(spark: SparkSession, path: str) -> dict:
    """delimiter (the most frequent candidate in the first line) and encoding: UTF-8 (a mark is dropped), else windows-1252."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    return {"delimiter": max(DELIMITERS, key=line.count), "encoding": "windows-1252" if bad else "UTF-8"}


def guess_mapping(columns: list[str]) -> dict[str, str]:
    lower = {c.strip().lstrip("\ufeff").lower(): c for c in reversed(columns)}
    found = {role: next((lower[n] for n in names if n in lower), None) for role, names in ROLES.items()}
    return {k: v for k, v in found.items() if v}


def read_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None, delimiter: str | None = None, encoding: str | None = None) -> EventLog:
    """A log from delimited text with a header.

    Rows without a case id are dropped. A case is sorted by time if all its events have one, else it stays in file
    order. Windows-1252 is read as Latin-1, and the letters in which the two differ are replaced.
    """
    if delimiter is None or encoding is None:
        found = sniff(spark, path)
        delimiter, encoding = delimiter or found["delimiter"], encoding or found["encoding"]
    western = encoding.lower() in ("windows-1252", "cp1252")
    raw = spark.read.csv(path, header=True, sep=delimiter, encoding="ISO-8859-1" if western else encoding)
    if western:
        raw = raw.select(*(F.translate(F.col(f"`{c}`"), *CP1252).alias(c.translate(str.maketrans(*CP1252))) for c in raw.columns))
    raw = raw.toDF(*(c.lstrip("\ufeff") for c in raw.columns))
    roles = mapping or guess_mapping(raw.columns)
    if "case" not in roles or "activity" not in roles:
        raise ValueError(f"no case or activity column in {raw.columns}")
    cell = lambda role: F.col(f"`{roles[role]}`") if role in roles else F.lit(None).cast("string")
    own = {"case_id", "pos", "activity", "ts", "lifecycle", "resource", "tz_offset_min", "order_", "timed_"}
    raw = raw.withColumnsRenamed({c: f"csv:{c}" for c in raw.columns if c in own and c not in roles.values()})
    rest = [c for c in raw.columns if c not in roles.values()]
    order = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    rows = raw.select(
        F.trim(cell("case")).alias("case_id"),
        F.trim(cell("activity")).alias("activity"),
        parse_timestamp(cell("ts")).alias("ts"),
        utc_offset_minutes(F.coalesce(cell("ts"), F.lit(""))).alias("tz_offset_min"),
        F.lower(F.trim(cell("lifecycle"))).alias("lifecycle"),
        F.trim(cell("resource")).alias("resource"),
        *(F.when(F.trim(f"`{c}`") != "", F.col(f"`{c}`")).alias(c) for c in rest),
        order.alias("order_"),
    ).filter("case_id is not null and case_id <> ''")
    whole = W.partitionBy("case_id")
    rows = rows.withColumn("timed_", F.min(F.col("ts").isNotNull()).over(whole))
    by = whole.orderBy(F.when(F.col("timed_"), F.col("ts")), "order_")
    events = rows.withColumn("pos", F.row_number().over(by) - 1)
    cases = events.groupBy("case_id").agg(F.min("order_").alias("first"))
    return EventLog(cases, events.select("case_id", "pos", "activity", "ts", "lifecycle", "resource", "tz_offset_min", *(f"`{c}`" for c in rest)))


def write_csv(log: EventLog, path: str, delimiter: str = ",") -> None:
    """Case id, standard columns, other event columns by name, then case columns; lists joined by '|', times as ISO."""
    flat = to_table(log)
    heads = {"case_id": "case:concept:name", "activity": "concept:name", "ts": "time:timestamp", "resource": "org:resource", "lifecycle": "lifecycle:transition"}
    rest = sorted(c for c in flat.columns if c not in heads and c not in ("pos", "tz_offset_min") and not c.startswith("case:"))
    kinds = dict(flat.dtypes)

    def cell(c: str):
        col = F.col(f"`{c}`")
        if kinds[c] == "timestamp":
            return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias(heads.get(c, c))
        if kinds[c].startswith("array"):
            return F.array_join(col.cast("array<string>"), "|").alias(heads.get(c, c))
        return col.cast("string").alias(heads.get(c, c))

    names = [*heads, *rest, *sorted(c for c in flat.columns if c.startswith("case:"))]
    flat.sortWithinPartitions("case_id", "pos").select(*(cell(c) for c in names)).write.csv(path, header=True, sep=delimiter)


def save_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)
