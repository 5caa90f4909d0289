"""Textbook notation: [<a,b>^3, <c>]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SUPERSCRIPTS, DIGITS = "⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"
TRACE = r"<([^<>]*)>\s*(?:\^\s*(\d+))?"


def parse_notation(lines: DataFrame, column: str = "value") -> DataFrame:
    """variant, n, first of all lines of text; repeated traces add up, a count of 0 drops one, no trace at all is an error."""
    plain = F.regexp_replace(F.col(column), f"([{SUPERSCRIPTS}]+)", "^$1")
    plain = F.translate(plain, "⟨⟩" + SUPERSCRIPTS, "<>" + DIGITS)
    found = lines.select(F.posexplode(F.arrays_zip(F.regexp_extract_all(plain, F.lit(TRACE), F.lit(1)).alias("body"), F.regexp_extract_all(plain, F.lit(TRACE), F.lit(2)).alias("power"))).alias("at", "t"))
    if not found.limit(1).count():
        raise ValueError("no trace in the text")
    names = F.filter(F.transform(F.split("t.body", ","), lambda x: F.trim(x)), lambda x: x != "")
    rows = found.select(names.alias("variant"), F.when(F.col("t.power") == "", 1).otherwise(F.col("t.power").cast("long")).cast("long").alias("n"), "at")
    return rows.groupBy("variant").agg(F.sum("n").alias("n"), F.struct(F.min("at")).alias("first")).filter("n > 0")
