"""Transition systems as text: 's0 -a-> s1, s1 -b-> s2', with lines 'initial:', 'final:' and 'states:'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEP = r"^\s*(.+?)\s*-\s*(.+?)\s*->\s*(.+?)\s*$"


def parse_transition_system(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Edges (src, event, dst, n) and states (state, is_initial, is_final); without an initial line the first source is it."""
    value = F.regexp_replace(F.col(column), r"\\(?:xrightarrow|stackrel)\s*\{([^{}]*)\}(?:\s*\{\\(?:right|long)arrow\})?", " -$1-> ")
    rows = lines.select(F.monotonically_increasing_id().alias("line"), F.trim(F.regexp_replace(value, r"\$", "")).alias("v"))
    told = rows.select("line", F.lower(F.regexp_extract("v", r"^(initial|final|states)\s*:", 1)).alias("what"), F.regexp_replace("v", r"^(?i)(initial|final|states)\s*:", "").alias("v"))
    parts = told.select("line", "what", F.posexplode(F.split("v", r"[,;](?![^\[({⟨]*[\])}⟩])")).alias("at", "part")).withColumn("part", F.trim("part")).filter("part <> ''")
    steps = parts.filter("what = ''").select("line", "at", *(F.trim(F.regexp_extract("part", STEP, k)).alias(n) for k, n in ((1, "src"), (2, "event"), (3, "dst")))).filter("event <> ''")
    edges = steps.groupBy("src", "event", "dst").agg(F.count("*").alias("n"))
    named = lambda what: parts.filter(F.col("what") == what).select(F.col("part").alias("state"))
    first = steps.agg(F.min_by("src", F.struct("line", "at")).alias("first"))
    states = edges.select(F.col("src").alias("state")).unionByName(edges.select(F.col("dst").alias("state"))).unionByName(parts.filter("what <> ''").select(F.col("part").alias("state"))).distinct()
    initial = named("initial").distinct().withColumn("i", F.lit(True))
    final = named("final").distinct().withColumn("f", F.lit(True))
    declared = named("initial").agg((F.count("*") > 0).alias("declared"))
    out = states.join(initial, "state", "left").join(final, "state", "left").crossJoin(F.broadcast(first)).crossJoin(F.broadcast(declared))  # one row each
    begins = F.when(F.col("declared"), F.coalesce("i", F.lit(False))).otherwise(F.col("state").eqNullSafe(F.col("first")))
    return edges, out.select("state", begins.alias("is_initial"), F.coalesce("f", F.lit(False)).alias("is_final"))


def transition_system_text(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Lines of text (value) that give the system back."""
    step = edges.select(F.concat("src", F.lit(" -"), "event", F.lit("-> "), "dst").alias("value"))
    line = lambda test, name: states.filter(test).select(F.concat(F.lit(f"{name}: "), "state").alias("value"))
    return step.unionByName(line("is_initial", "initial")).unionByName(line("is_final", "final"))
