"""Transition systems from logs, regions, and prefix languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


def _bag_text(xs: Column) -> Column:
    part = lambda x: F.concat(x, F.when(F.size(F.filter(xs, lambda y: y == x)) > 1, F.concat(F.lit("^"), F.size(F.filter(xs, lambda y: y == x)).cast("string"))).otherwise(F.lit("")))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.array_distinct(xs)), part), ","), F.lit("]"))


def _state(xs: Column, representation: str) -> Column:
    if representation == "sequence":
        return F.concat(F.lit("⟨"), F.array_join(xs, ","), F.lit("⟩"))
    if representation == "multiset":
        return _bag_text(xs)
    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.array_distinct(xs)), ","), F.lit("}"))


def transition_system(table: DataFrame, direction: str = "prefix", representation: str = "set", horizon: int = 0) -> tuple[DataFrame, DataFrame]:
    """Edges (src, event, dst, n) and states (state, is_initial, is_final). A horizon under 1 looks at whole prefixes or postfixes."""

    def state_at(i: Column) -> Column:
        size = F.size("variant")
        took = F.least(i, F.lit(horizon)) if horizon >= 1 else i
        before = F.slice("variant", i - took + 1, took)
        left = F.least(size - i, F.lit(horizon)) if horizon >= 1 else size - i
        after = F.slice("variant", i + 1, left)
        if direction == "prefix":
            return _state(before, representation)
        if direction == "postfix":
            return _state(after, representation)
        return F.concat(F.lit("("), _state(before, representation), F.lit(", "), _state(after, representation), F.lit(")"))

    walks = table.select("n", F.size("variant").alias("size"), "variant", F.explode(F.sequence(F.lit(0), F.size("variant"))).alias("i"))
    places = walks.select("n", "size", "i", state_at(F.col("i")).alias("state"))
    states = places.groupBy("state").agg(F.bool_or(F.col("i") == 0).alias("is_initial"), F.bool_or(F.col("i") == F.col("size")).alias("is_final"))
    steps = walks.filter("i < size").select("n", state_at(F.col("i")).alias("src"), F.get("variant", F.col("i")).alias("event"), state_at(F.col("i") + 1).alias("dst"))
    return steps.groupBy("src", "event", "dst").agg(F.sum("n").alias("n")), states


def reachable(edges: DataFrame, states: DataFrame) -> DataFrame:
    """States that can be reached from the initial ones, by frontiers."""
    found = cut(states.filter("is_initial").select("state"), "reach")
    frontier = found
    while True:
        step = edges.join(frontier, edges["src"] == frontier["state"]).select(F.col("dst").alias("state")).distinct()
        frontier = cut(step.join(found, "state", "left_anti"), "reach")
        if not frontier.limit(1).count():
            return found
        found = cut(found.unionByName(frontier), "reach")


def successors(edges: DataFrame) -> DataFrame:
    """state, event, successors."""
    return edges.groupBy(F.col("src").alias("state"), "event").agg(F.array_sort(F.collect_set("dst")).alias("successors"))


def event_crossings(edges: DataFrame, members: DataFrame) -> DataFrame:
    """event, kinds: how its edges stand to a set of states: 'enter', 'exit', 'no cross' (inside or outside)."""
    inside = members.select(F.col("state")).distinct()
    both = edges.join(inside.withColumn("in_src", F.lit(True)), edges["src"] == F.col("state"), "left").drop("state")
    both = both.join(inside.withColumn("in_dst", F.lit(True)), F.col("dst") == F.col("state"), "left").drop("state").fillna(False, ["in_src", "in_dst"])
    kind = F.when(F.col("in_src") & ~F.col("in_dst"), "exit").when(~F.col("in_src") & F.col("in_dst"), "enter").otherwise("no cross")
    return both.groupBy("event").agg(F.array_sort(F.collect_set(kind)).alias("kinds"))


def is_region(edges: DataFrame, states: DataFrame, members: DataFrame) -> DataFrame:
    """One row: region (every event behaves alike), trivial (none or all states), unknown (members that are no states), breaks_on (first event)."""
    crossings = event_crossings(edges, members)
    bad = crossings.agg(F.min(F.when(F.size("kinds") > 1, F.col("event"))).alias("breaks_on"))
    inside = members.select("state").distinct()
    unknown = inside.join(states, "state", "left_anti").agg(F.count("*").alias("unknown"))
    known = inside.join(states, "state", "left_semi").agg(F.count("*").alias("known")).crossJoin(states.agg(F.count("*").alias("all")))
    out = bad.crossJoin(unknown).crossJoin(known)  # one row each
    return out.select((F.col("breaks_on").isNull() & (F.col("unknown") == 0)).alias("region"), ((F.col("known") == 0) | (F.col("known") == F.col("all"))).alias("trivial"), "unknown", "breaks_on")


def excitation_regions(edges: DataFrame) -> DataFrame:
    """event, states in which it can happen."""
    return edges.groupBy("event").agg(F.array_sort(F.collect_set("src")).alias("states"))


def prefixes(table: DataFrame) -> DataFrame:
    """prefix: the non-empty prefixes of all variants."""
    each = table.filter(F.size("variant") > 0).select("variant", F.explode(F.sequence(F.lit(1), F.size("variant"))).alias("k"))
    return each.select(F.slice("variant", F.lit(1), F.col("k")).alias("prefix")).distinct()


def language_matrix(table: DataFrame, without_last: bool = False) -> DataFrame:
    """prefix (text), activity, count: how often each activity occurs in each prefix, or before its last event."""
    rows = prefixes(table)
    counted = F.slice("prefix", F.lit(1), F.size("prefix") - 1) if without_last else F.col("prefix")
    each = rows.select(F.array_join("prefix", ",").alias("text"), F.explode_outer(counted).alias("activity"))
    return each.groupBy("text", "activity").agg(F.count("activity").alias("count"))
