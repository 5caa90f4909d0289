"""Directly-follows graphs and footprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import BY_NAME, Classifier, EventLog, seconds
from ..runtime import cut
from .ranges import quantiles, with_neighbours

START, END = "▶", "■"


@dataclass(frozen=True)
class DFG:
    """``nodes`` (activity, n, n_start, n_end), ``edges`` (a, b, n) and ``totals`` (traces, empty_traces; one row)."""

    nodes: DataFrame
    edges: DataFrame
    totals: DataFrame


def edges_of_variants(table: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip(F.slice("variant", 1, F.greatest(F.size("variant") - 1, F.lit(0))).alias("a"), F.slice("variant", 2, F.greatest(F.size("variant") - 1, F.lit(0))).alias("b")))
    return table.filter(F.size("variant") > 1).select("n", pairs.alias("p")).groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


def nodes_of_variants(table: DataFrame) -> DataFrame:
    each = table.select("n", F.size("variant").alias("size"), F.posexplode("variant").alias("at", "activity"))
    return each.groupBy("activity").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("at") == 0, F.col("n")).otherwise(0)).alias("n_start"),
        F.sum(F.when(F.col("at") == F.col("size") - 1, F.col("n")).otherwise(0)).alias("n_end"),
    )


def dfg_of_variants(table: DataFrame) -> DFG:
    totals = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("traces"), F.coalesce(F.sum(F.when(F.size("variant") == 0, F.col("n"))), F.lit(0)).alias("empty_traces"))
    return DFG(nodes_of_variants(table), edges_of_variants(table), totals)


def discover_dfg(log: EventLog, classifier: Classifier = BY_NAME) -> DFG:
    """The graph from neighbouring events: one exchange by case; a case that is very long is ordered by several tasks."""
    taken = log.events.filter(classifier.accepts()).select("case_id", "pos", classifier.label().alias("a"))
    rows = with_neighbours(taken, ["case_id"], [F.col("pos")], {"before": "a"}, {"b": "a"})
    nodes = rows.groupBy(F.col("a").alias("activity")).agg(F.count("*").alias("n"), F.count_if(F.col("before").isNull()).alias("n_start"), F.count_if(F.col("b").isNull()).alias("n_end"))
    edges = rows.filter("b is not null").groupBy("a", "b").agg(F.count("*").alias("n"))
    cases = log.cases.select("case_id").join(taken.select("case_id", F.lit(True).alias("some")).distinct(), "case_id", "left")
    return DFG(nodes, edges, cases.agg(F.count("*").alias("traces"), F.count_if(F.col("some").isNull()).alias("empty_traces")))


def edge_durations(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    """a, b, n, timed, mean_s, median_s: durations where both events have times; negative ones count as they are.

    Events are exchanged by case once; means and medians are read off the counts of each edge's distinct durations.
    """
    taken = log.events.filter(classifier.accepts()).select("case_id", "pos", "ts", classifier.label().alias("a"))
    near = with_neighbours(taken, ["case_id"], [F.col("pos")], {}, {"b": "a", "to": "ts"}).filter("b is not null")
    counted = cut(near.groupBy("a", "b", seconds("ts", "to").alias("s")).agg(F.count("*").alias("k")), "durations")
    total = F.sum(F.when(F.col("s").isNotNull(), F.col("k")))
    means = counted.groupBy("a", "b").agg(F.sum("k").alias("n"), F.coalesce(total, F.lit(0)).alias("timed"), (F.sum(F.col("s") * F.col("k")) / total).alias("mean_s"))
    return means.join(quantiles(counted, ["a", "b"], "s", {"median_s": 0.5}, "k"), ["a", "b"], "left")


def all_edges(graph: DFG) -> DataFrame:
    """Edges with the virtual start and end."""
    starts = graph.nodes.filter("n_start > 0").select(F.lit(START).alias("a"), F.col("activity").alias("b"), F.col("n_start").alias("n"))
    ends = graph.nodes.filter("n_end > 0").select(F.col("activity").alias("a"), F.lit(END).alias("b"), F.col("n_end").alias("n"))
    return graph.edges.unionByName(starts).unionByName(ends)


def simplified(graph: DFG, activity_fraction: float, edge_fraction: float) -> DFG:
    """The most frequent activities and edges, and for every kept activity its best edge in and out.

    All windows run over tables of the alphabet's size.
    """
    m = graph.nodes.agg(F.greatest(F.bround(F.count("*") * F.lit(activity_fraction), 0), F.lit(1)).alias("most"))
    ranked = graph.nodes.withColumn("r", F.row_number().over(W.orderBy(F.desc("n"), "activity")))
    nodes = ranked.crossJoin(F.broadcast(m)).filter("r <= most").drop("r", "most")
    names = nodes.select("activity")
    inside = graph.edges.join(F.broadcast(names.withColumnRenamed("activity", "a")), "a").join(F.broadcast(names.withColumnRenamed("activity", "b")), "b").select("a", "b", "n")
    k = inside.agg(F.bround(F.count("*") * F.lit(edge_fraction), 0).alias("most"))
    by = [F.desc("n"), F.col("a"), F.col("b")]
    marked = inside.withColumns({
        "r": F.row_number().over(W.orderBy(*by)),
        "r_in": F.row_number().over(W.partitionBy("b").orderBy(*by)),
        "r_out": F.row_number().over(W.partitionBy("a").orderBy(*by)),
    })
    edges = marked.crossJoin(F.broadcast(k)).filter("r <= most or r_in = 1 or r_out = 1").select("a", "b", "n")
    return DFG(nodes, edges, graph.totals)


def neighbours(graph: DFG) -> DataFrame:
    """activity, successors, predecessors (sorted)."""
    out = graph.edges.groupBy(F.col("a").alias("activity")).agg(F.array_sort(F.collect_set("b")).alias("successors"))
    into = graph.edges.groupBy(F.col("b").alias("activity")).agg(F.array_sort(F.collect_set("a")).alias("predecessors"))
    none = F.array().cast("array<string>")
    both = graph.nodes.select("activity").join(out, "activity", "left").join(into, "activity", "left")
    return both.withColumns({c: F.coalesce(c, none) for c in ("successors", "predecessors")})


def map_annotations(graph: DFG, durations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with relative and log-scaled frequency and a rare flag; edges also with relative slowness and a slow flag."""
    top = graph.nodes.agg(F.max("n").alias("most"))
    nodes = graph.nodes.crossJoin(F.broadcast(top)).withColumns({"relative": F.col("n") / F.col("most"), "fill": F.log1p("n") / F.log1p("most")}).withColumn("rare", F.col("relative") <= 0.15).drop("most")
    top = graph.edges.agg(F.max("n").alias("most"))
    edges = graph.edges.crossJoin(F.broadcast(top)).withColumns({"relative": F.col("n") / F.col("most"), "fill": F.log1p("n") / F.log1p("most")}).withColumn("rare", F.col("relative") <= 0.15).drop("most")
    if durations is not None:
        slowest = durations.agg(F.max("mean_s").alias("slowest"))
        pace = durations.crossJoin(F.broadcast(slowest)).select("a", "b", F.when(F.col("slowest") > 0, F.col("mean_s") / F.col("slowest")).otherwise(0.0).alias("slowness"))
        edges = edges.join(pace, ["a", "b"], "left").withColumn("slow", F.col("slowness") > 0.66)
    return nodes, edges


def footprint(activities: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, relation for every ordered pair of activities (a table of the alphabet's square)."""
    names = activities.select("activity").distinct()
    pairs = names.select(F.col("activity").alias("a")).crossJoin(names.select(F.col("activity").alias("b")))
    there = edges.select("a", "b", F.lit(True).alias("ab"))
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(True).alias("ba"))
    found = pairs.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").fillna(False, ["ab", "ba"])
    relation = F.when(F.col("ab") & F.col("ba"), "‖").when(F.col("ab"), "→").when(F.col("ba"), "←").otherwise("#")
    return found.select("a", "b", relation.alias("relation"))


def footprint_of_log(log: EventLog, classifier: Classifier = BY_NAME) -> DataFrame:
    graph = discover_dfg(log, classifier)
    return footprint(graph.nodes, graph.edges)


def footprint_matrix(relations: DataFrame, activities: list[str] | None = None) -> DataFrame:
    grouped = relations.groupBy("a")
    return (grouped.pivot("b", activities) if activities else grouped.pivot("b")).agg(F.first("relation"))


def compare_footprints(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells over the union of both alphabets (a, b, left, right, same), and one row: cells, differing, fitness."""
    names = left.select("a").unionByName(right.select("a")).distinct()
    pairs = names.crossJoin(names.select(F.col("a").alias("b")))
    cells = pairs.join(left.withColumnRenamed("relation", "left"), ["a", "b"], "left").join(right.withColumnRenamed("relation", "right"), ["a", "b"], "left").fillna("#", ["left", "right"])
    cells = cells.withColumn("same", F.col("left") == F.col("right"))
    total = cells.agg(F.count("*").alias("cells"), F.count_if(~F.col("same")).alias("differing"))
    return cells, total.withColumn("fitness", F.when(F.col("cells") == 0, 1.0).otherwise(1 - F.col("differing") / F.col("cells")))
