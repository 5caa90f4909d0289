"""Dependency graphs, causal bindings and their nets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..nets import Net
from ..runtime import cut, rows_of
from .dfg import edges_of_variants, nodes_of_variants

START, END = "▶ start", "■ end"


def dependencies(edges: DataFrame) -> DataFrame:
    """a, b, n, value: (ab - ba) / (ab + ba + 1), for a loop aa / (aa + 1)."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    both = edges.join(back, ["a", "b"], "left").fillna(0, ["m"])
    value = F.when(F.col("a") == F.col("b"), F.col("n") / (F.col("n") + 1)).otherwise((F.col("n") - F.col("m")) / (F.col("n") + F.col("m") + 1))
    return both.select("a", "b", "n", value.alias("value"))


def two_loops(table: DataFrame) -> DataFrame:
    """a, b, n, value: occurrences of a b a, and (ab + ba) / (ab + ba + 1) of them."""
    at = F.sequence(F.lit(0), F.size("variant") - 3)
    triples = table.filter(F.size("variant") > 2).select("n", F.explode(F.transform(at, lambda i: F.struct(F.get("variant", i).alias("a"), F.get("variant", i + 1).alias("b"), F.get("variant", i + 2).alias("c")))).alias("p"))
    counts = triples.filter("p.a = p.c and p.a <> p.b").groupBy("p.a", "p.b").agg(F.sum("n").alias("n"))
    back = counts.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("n").alias("m"))
    both = counts.join(back, ["a", "b"], "left").fillna(0, ["m"])
    return both.select("a", "b", "n", ((F.col("n") + F.col("m")) / (F.col("n") + F.col("m") + 1)).alias("value"))


def dependency_graph(table: DataFrame, dependency_threshold: float = 0.9, min_observations: int = 1, loop_two_threshold: float = 0.5, all_tasks_connected: bool = True) -> DataFrame:
    """a, b, value, n: edges by threshold; mutual loops of length two overwrite; then each activity's best edges fill gaps."""
    edges, nodes = edges_of_variants(table), nodes_of_variants(table)
    deps = dependencies(edges)
    by_threshold = deps.filter((F.col("value") >= dependency_threshold) & (F.col("n") >= min_observations)).select("a", "b", "value", "n", F.lit(2).alias("level"))
    loops = two_loops(table).filter(F.col("value") >= loop_two_threshold).select("a", "b", "value")
    both = loops.unionByName(loops.select(F.col("b").alias("a"), F.col("a").alias("b"), "value")).distinct()
    mutual = both.join(edges, ["a", "b"]).select("a", "b", "value", "n", F.lit(1).alias("level"))
    found = by_threshold.unionByName(mutual)
    if all_tasks_connected:
        plain = deps.filter("a <> b")
        out = plain.withColumn("r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("value"), F.desc("b")))).filter("r = 1")
        out = out.join(nodes.filter("n_end = 0").select(F.col("activity").alias("a")), "a", "left_semi")
        into = plain.withColumn("r", F.row_number().over(W.partitionBy("b").orderBy(F.desc("value"), F.desc("a")))).filter("r = 1")
        into = into.join(nodes.filter("n_start = 0").select(F.col("activity").alias("b")), "b", "left_semi")
        best = out.unionByName(into).select("a", "b", "value", "n").distinct()
        found = found.unionByName(best.withColumn("level", F.lit(3)))
    return found.groupBy("a", "b").agg(F.min_by(F.struct("value", "n"), "level").alias("x")).select("a", "b", "x.value", "x.n")


def bindings(table: DataFrame, graph: DataFrame) -> DataFrame:
    """side ('out' or 'in'), activity, binding (sorted), n.

    b is in the output binding of a at a place if it comes after it and before the next a; inputs mirror that. Only the
    nearest place of the other activity decides, so the places of both ends of an edge are put in order per variant and
    edge: rows grow with the places and the graph's degree, not with pairs of places.
    """
    # tables that several branches read are written once: recomputed, they would double with every branch
    graph = cut(graph, "dependency-graph")
    rows = cut(table.select("variant", "n", F.xxhash64("variant").alias("v"), F.size("variant").alias("size")), "binding-variants")
    empty = rows.filter("size = 0").select("n")
    virtual = empty.select(F.lit("out").alias("side"), F.lit(START).alias("activity"), F.array(F.lit(END)).alias("binding"), "n")
    virtual = virtual.unionByName(empty.select(F.lit("in").alias("side"), F.lit(END).alias("activity"), F.array(F.lit(START)).alias("binding"), "n"))
    ends = rows.filter("size > 0")
    virtual = virtual.unionByName(ends.select(F.lit("out").alias("side"), F.lit(START).alias("activity"), F.array(F.get("variant", F.lit(0))).alias("binding"), "n"))
    virtual = virtual.unionByName(ends.select(F.lit("in").alias("side"), F.lit(END).alias("activity"), F.array(F.try_element_at("variant", F.lit(-1))).alias("binding"), "n"))
    places = rows.select("v", "n", "size", F.posexplode("variant").alias("i", "a"))
    own = W.partitionBy("v", "a").orderBy("i")
    places = places.withColumns({"next": F.coalesce(F.lead("i").over(own), F.col("size")), "prev": F.coalesce(F.lag("i").over(own), F.lit(-1))})
    places = cut(places, "places")
    edges = F.broadcast(graph.filter("a <> b").select(F.col("a").alias("ea"), F.col("b").alias("eb")))
    base = places.select("v", "n", "size", "i", "a", "next", "prev")
    tails = places.join(edges, F.col("a") == F.col("ea")).select("v", "ea", "eb", "i", F.lit(True).alias("tail"), F.col("next").alias("bound"))
    heads = places.join(edges, F.col("a") == F.col("eb")).select("v", "ea", "eb", "i", F.lit(False).alias("tail"), F.col("prev").alias("bound"))
    edge = W.partitionBy("v", "ea", "eb")
    seen = lambda order, tail: F.last(F.when(F.col("tail") == tail, F.col("i")), ignorenulls=True).over(edge.orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    meet = cut(tails.unionByName(heads).withColumns({"after": seen(F.desc("i"), False), "before": seen(F.asc("i"), True)}), "meetings")
    loops = F.broadcast(graph.filter("a = b").select("a"))

    def side(name: str, found: DataFrame, loop, edge_test, virtual_name: str) -> DataFrame:
        again = base.join(loops, "a").filter(loop).select("v", "i", F.col("a").alias("b"))
        border = base.filter(edge_test).select("v", "i", F.lit(virtual_name).alias("b"))
        grouped = found.unionByName(again).unionByName(border).groupBy("v", "i").agg(F.array_sort(F.collect_set("b")).alias("binding"))
        return grouped.join(base.select("v", "i", "a", "n"), ["v", "i"]).select(F.lit(name).alias("side"), F.col("a").alias("activity"), "binding", "n")

    out = side("out", meet.filter("tail and after < bound").select("v", "i", F.col("eb").alias("b")), F.col("next") == F.col("i") + 1, F.col("i") == F.col("size") - 1, END)
    into = side("in", meet.filter("not tail and before > bound").select("v", "i", F.col("ea").alias("b")), F.col("prev") == F.col("i") - 1, F.col("i") == 0, START)
    return virtual.unionByName(out).unionByName(into).groupBy("side", "activity", "binding").agg(F.sum("n").alias("n"))


def heuristics_net(found: DataFrame) -> Net:
    """The net of bindings (a table of the alphabet's size): a place per used arc, a silent transition per binding where an activity has several."""
    rows = rows_of(found)
    net = Net()
    net.place("start", first=1)
    net.place("end", last=1)
    sides: dict[str, dict[str, list[tuple[str, ...]]]] = {"in": {}, "out": {}}
    for r in rows:
        sides[r["side"]].setdefault(r["activity"], []).append(tuple(r["binding"]))
    names = sorted({r["activity"] for r in rows})
    arc = lambda a, b: net.place(f"p({a},{b})")
    for a in names:
        net.transition(a, None if a in (START, END) else a)
        for side, mine in (("in", lambda x, a=a: arc(x, a)), ("out", lambda x, a=a: arc(a, x))):
            options = sorted(sides[side].get(a, []))
            border = "start" if side == "in" and a == START else "end" if side == "out" and a == END else None
            if border:
                net.arcs[(border, a) if side == "in" else (a, border)] = 1
            elif len(options) == 1:
                for x in options[0]:
                    net.arcs[(mine(x), a) if side == "in" else (a, mine(x))] = 1
            elif options:
                hub = net.place(f"{side}({a})")
                net.arcs[(hub, a) if side == "in" else (a, hub)] = 1
                for k, option in enumerate(options):
                    ends = [mine(x) for x in option]
                    net.transition(f"τ {side} {a} {k}", None, ends if side == "in" else [hub], [hub] if side == "in" else ends)
    return net.fuse_silent()
