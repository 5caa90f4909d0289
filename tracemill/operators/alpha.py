"""Relations and nets of the alpha algorithm."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..nets import Net
from ..runtime import cut, rows_of


def task_sets(nodes: DataFrame) -> DataFrame:
    """One row: all activities, first ones and last ones, sorted."""
    named = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("activity"))))
    return nodes.agg(named(F.lit(True)).alias("t_l"), named(F.col("n_start") > 0).alias("t_i"), named(F.col("n_end") > 0).alias("t_o"))


def _relations(foot: DataFrame) -> DataFrame:
    """activity, apart (unrelated activities, itself if so), after (those it causes), before (those that cause it)."""
    some = lambda r: F.array_sort(F.collect_set(F.when(F.col("relation") == r, F.col("b"))))
    return foot.groupBy(F.col("a").alias("activity")).agg(some("#").alias("apart"), some("→").alias("after"), some("←").alias("before"))


def _grown(pairs: DataFrame, relations: DataFrame, side: str, other: str, rule: str, beyond: bool) -> DataFrame:
    """pairs with one more activity c on ``side``: unrelated to all there, related by ``rule`` to all on the other side."""
    first = relations.select(F.col("activity").alias("first"), F.col("apart").alias("options"))
    new = relations.select(F.col("activity").alias("c"), F.col("apart").alias("c_apart"), F.col(rule).alias("c_rule"))
    found = pairs.join(F.broadcast(first), pairs[side][0] == F.col("first")).withColumn("c", F.explode("options")).filter(~F.array_contains(side, F.col("c")))
    if beyond:
        found = found.filter(F.col("c") > F.array_max(side))
    found = found.join(F.broadcast(new), "c")
    ok = F.array_contains("c_apart", F.col("c")) & (F.size(F.array_except(side, "c_apart")) == 0) & (F.size(F.array_except(other, "c_rule")) == 0)
    return found.filter(ok)


def place_pairs(foot: DataFrame) -> DataFrame:
    """a, b (arrays), maximal: all pairs of activity sets between which a place may stand.

    Pairs grow by one activity a round, first on the left, then on the right; the tables have the alphabet's size.
    """
    relations = cut(_relations(foot), "alpha-relations")
    alone = relations.filter(F.array_contains("apart", F.col("activity"))).select("activity")
    start = foot.filter("relation = '→'").join(F.broadcast(alone.withColumnRenamed("activity", "a")), "a").join(F.broadcast(alone.withColumnRenamed("activity", "b")), "b")
    found = cut(start.select(F.array("a").alias("a"), F.array("b").alias("b")), "alpha")
    for side, other, rule in (("a", "b", "after"), ("b", "a", "before")):
        edge = found
        while True:
            grown = _grown(edge, relations, side, other, rule, beyond=True)
            edge = cut(grown.select(*(F.concat(x, F.array("c")).alias(x) if x == side else x for x in ("a", "b"))).distinct(), "alpha")
            if not edge.limit(1).count():
                break
            found = cut(found.unionByName(edge), "alpha")
    more = _grown(found, relations, "a", "b", "after", beyond=False).select("a", "b").unionByName(_grown(found, relations, "b", "a", "before", beyond=False).select("a", "b")).distinct()
    return found.join(more.withColumn("more", F.lit(True)), ["a", "b"], "left").select("a", "b", F.col("more").isNull().alias("maximal"))


def alpha_net(tasks: DataFrame, pairs: DataFrame) -> Net:
    """Places for the maximal pairs, and a source and a sink."""
    one = tasks.first()
    net = Net()
    net.place("i_L", first=1)
    net.place("o_L", last=1)
    for t in one["t_l"]:
        net.transition(t, t)
    for t in one["t_i"]:
        net.arcs["i_L", t] = 1
    for t in one["t_o"]:
        net.arcs[t, "o_L"] = 1
    for r in rows_of(pairs.filter("maximal").orderBy(F.size("a") + F.size("b"), "a", "b")):
        p = net.place(f"p({{{','.join(r['a'])}}},{{{','.join(r['b'])}}})")
        for a in r["a"]:
            net.arcs[a, p] = 1
        for b in r["b"]:
            net.arcs[p, b] = 1
    return net


def loop_warnings(table: DataFrame) -> DataFrame:
    """kind ('length one' or 'length two'), a, b: loops that the algorithm cannot see; b is null for length one."""
    at = F.sequence(F.lit(0), F.size("variant") - 2)
    pairs = table.filter(F.size("variant") > 1).select(F.explode(F.transform(at, lambda i: F.struct(F.get("variant", i).alias("x"), F.get("variant", i + 1).alias("y"), F.get("variant", i + 2).alias("z")))).alias("p")).select("p.*")
    one = pairs.filter("x = y").select(F.lit("length one").alias("kind"), F.col("x").alias("a"), F.lit(None).cast("string").alias("b"))
    two = pairs.filter("x = z and x <> y").select(F.lit("length two").alias("kind"), F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return one.unionByName(two).distinct()


def judge_place(candidates: DataFrame, foot: DataFrame, pairs: DataFrame) -> DataFrame:
    """candidates (a, b) with answer: 'yes', 'a relation forbids it' or 'not maximal'."""
    sorted_ = candidates.select(F.array_sort("a").alias("a"), F.array_sort("b").alias("b"))
    return sorted_.join(pairs, ["a", "b"], "left").select("a", "b", F.when(F.col("maximal").isNull(), "a relation forbids it").when(F.col("maximal"), "yes").otherwise("not maximal").alias("answer"))
