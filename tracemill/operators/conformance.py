"""Logs held against nets: replay, alignments, precision, generalisation, simplicity, and trace tables against each other.

Tasks find the firings of each distinct variant; all counting is done on columns. The net is small and travels with
the function.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..nets import MARKINGS, Net

FIRED = "variant array<string>, n long, steps array<struct<at:int,transition:string,lacks:map<string,long>>>, unknown_at array<int>, lacking map<string,long>, left_over map<string,long>"
ALIGNED = "variant array<string>, n long, cost long, moves array<struct<log:string,model:string,transition:string,kind:string>>"


def _sums(pairs: Column) -> Column:
    """A map with the sum of the values of each key, from an array of (key, value)."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), _total(F.filter(pairs, lambda p: p["key"] == k)).alias("value"))))


def _total(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda acc, p: acc + p["value"])


def _weighed(steps: Column, weight: dict[str, int]) -> Column:
    """Sum over steps of a number that each transition has."""
    table = F.create_map(*(F.lit(x) for pair in weight.items() for x in pair)) if weight else F.lit(None).cast("map<string,int>")
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, s: acc + table[s["transition"]])


def token_replay(table: DataFrame, net: Net) -> DataFrame:
    """Per variant: token counts, fitness, whether it fits, problem positions and unknown activities."""

    def run(frames):
        play = net.play()
        named = lambda v, names: {p: int(x) for p, x in zip(names, v) if x}
        for pdf in frames:
            found = [play.replay(list(v)) for v in pdf["variant"]]
            steps = [[{"at": at, "transition": play.names[t], "lacks": named(lacks, play.places)} for at, t, lacks in f[0]] for f in found]
            yield pd.DataFrame({"variant": pdf["variant"], "n": pdf["n"], "steps": steps, "unknown_at": [f[1] for f in found], "lacking": [named(f[2], play.places) for f in found], "left_over": [named(f[3], play.places) for f in found]})

    pre = {t: sum(w for (_, x), w in net.arcs.items() if x == t) for t in net.transitions}
    post = {t: sum(w for (x, _), w in net.arcs.items() if x == t) for t in net.transitions}
    m0, mf = (sum(p[k] for p in net.places.values()) for k in (0, 1))
    one = lambda steps: F.transform(steps, lambda s: F.struct(s["transition"].alias("key"), F.lit(1).cast("long").alias("value")))
    lacks = F.concat(F.flatten(F.transform("steps", lambda s: F.map_entries(s["lacks"]))), F.map_entries("lacking"))
    forced = F.filter("steps", lambda s: F.size(s["lacks"]) > 0)
    out = table.select("variant", "n").mapInPandas(run, FIRED)
    out = out.select(
        "variant", "n",
        (m0 + _weighed(F.col("steps"), post)).alias("produced"), (mf + _weighed(F.col("steps"), pre)).alias("consumed"),
        _total(lacks).alias("missing"), _total(F.map_entries("left_over")).alias("remaining"),
        F.array_sort(F.concat("unknown_at", F.transform(forced, lambda s: s["at"]))).alias("problems"),
        F.transform("unknown_at", lambda k: F.get("variant", k)).alias("unknown"),
        _sums(one(F.col("steps"))).alias("fired"), _sums(one(forced)).alias("forced"), _sums(lacks).alias("missing_at"), F.col("left_over").alias("remaining_at"),
    )
    return out.withColumns({"fitness": _fitness("missing", "consumed", "remaining", "produced"), "fits": (F.col("missing") == 0) & (F.col("remaining") == 0) & (F.size("unknown") == 0)})


def _fitness(m, c, r, p):
    part = lambda a, b: F.when(F.col(b) == 0, F.lit(1.0)).otherwise(1 - F.col(a) / F.col(b))
    return 0.5 * part(m, c) + 0.5 * part(r, p)


def replay_fitness(replayed: DataFrame) -> DataFrame:
    """One row: fitness, cases, fitting cases."""
    sums = [F.sum(F.col(k) * F.col("n")).alias(k) for k in ("missing", "consumed", "remaining", "produced")]
    one = replayed.agg(*sums, F.sum("n").alias("cases"), F.coalesce(F.sum(F.when(F.col("fits"), F.col("n"))), F.lit(0)).alias("fitting"))
    return one.select(_fitness("missing", "consumed", "remaining", "produced").alias("fitness"), "cases", "fitting")


def replay_totals(replayed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """place, missing, remaining; and transition, fired, forced."""

    def total(column: str, key: str, name: str) -> DataFrame:
        return replayed.select("n", F.explode(column).alias(key, "v")).groupBy(key).agg(F.sum(F.col("n") * F.col("v")).alias(name))

    places = total("missing_at", "place", "missing").join(total("remaining_at", "place", "remaining"), "place", "full_outer").fillna(0)
    transitions = total("fired", "transition", "fired").join(total("forced", "transition", "forced"), "transition", "full_outer").fillna(0)
    return places, transitions


def align(table: DataFrame, net: Net, most: int = MARKINGS) -> DataFrame:
    """Per variant: cost, fitness and the moves of a cheapest alignment; fitness is 0 where the search gave up.

    Variants are dealt over partitions by a hash first, so that long ones do not lie together.
    """
    shortest = net.shortest_run()

    def run(frames):
        play = net.play()
        for pdf in frames:
            found = [play.align(list(v), most) for v in pdf["variant"]]
            moves = [[dict(zip(("log", "model", "transition", "kind"), m)) for m in path] for _, path in found]
            yield pd.DataFrame({"variant": pdf["variant"], "n": pdf["n"], "cost": pd.array([cost for cost, _ in found], "Int64"), "moves": moves})

    worst = F.size("variant") + shortest
    fitness = F.when(F.col("cost").isNull(), 0.0).when(worst == 0, 1.0).otherwise(1 - F.col("cost") / worst)
    return table.select("variant", "n").repartition(F.xxhash64("variant")).mapInPandas(run, ALIGNED).select("variant", "n", "cost", fitness.alias("fitness"), "moves")


def alignment_fitness(aligned: DataFrame, shortest: int) -> DataFrame:
    """One row: average_fitness over cases, log_fitness over all moves, cases, fitting cases."""
    one = aligned.agg(
        (F.sum(F.col("fitness") * F.col("n")) / F.sum("n")).alias("average_fitness"),
        F.sum(F.coalesce("cost", F.size("variant") + shortest) * F.col("n")).alias("cost"),
        F.sum((F.size("variant") + shortest) * F.col("n")).alias("worst"),
        F.sum("n").alias("cases"),
        F.coalesce(F.sum(F.when(F.col("cost") == 0, F.col("n"))), F.lit(0)).alias("fitting"),
    )
    return one.select("average_fitness", F.when(F.col("worst") == 0, 1.0).otherwise(1 - F.col("cost") / F.col("worst")).alias("log_fitness"), "cases", "fitting")


def move_statistics(aligned: DataFrame) -> DataFrame:
    """kind, activity, n of all moves but silent ones."""
    moves = aligned.select("n", F.explode("moves").alias("m")).filter("m.kind <> 'silent'")
    return moves.groupBy("m.kind", F.coalesce("m.log", "m.model").alias("activity")).agg(F.sum("n").alias("n"))


def precision(table: DataFrame, net: Net) -> DataFrame:
    """One row: precision by escaping edges. Prefixes that the net cannot replay without missing tokens are left out.

    Each variant is walked once; its prefixes meet by their digests.
    """

    def run(frames):
        play = net.play()
        for pdf in frames:
            prefixes, counts, seen, allowed = [], [], [], []
            for variant, n in zip(pdf["variant"], pdf["n"]):
                so_far = hashlib.sha256()
                for label, may in zip(variant, play.walk(list(variant))):
                    prefixes.append(so_far.digest())
                    counts.append(n)
                    seen.append(label)
                    allowed.append(may)
                    so_far.update(f"{len(label)}:{label}".encode())
            yield pd.DataFrame({"prefix": prefixes, "n": counts, "activity": seen, "allowed": allowed})

    steps = table.select("variant", "n").mapInPandas(run, "prefix binary, n long, activity string, allowed array<string>")
    found = steps.groupBy("prefix").agg(F.sum("n").alias("n"), F.collect_set("activity").alias("seen"), F.any_value("allowed").alias("allowed"))  # as many activities as the net has labels
    one = found.agg(F.sum(F.size(F.array_except("allowed", "seen")) * F.col("n")).alias("escaping"), F.sum(F.size("allowed") * F.col("n")).alias("allowed"))
    return one.select(F.when(F.coalesce("allowed", F.lit(0)) == 0, 1.0).otherwise(1 - F.col("escaping") / F.col("allowed")).alias("precision"))


def generalisation(replayed: DataFrame, net: Net) -> DataFrame:
    """One row, over all transitions, silent ones too."""
    spark = replayed.sparkSession
    names = spark.createDataFrame([(t,) for t in net.transitions], "transition string")
    fired = names.join(replay_totals(replayed)[1], "transition", "left").fillna(0)
    return fired.agg((1 - F.coalesce(F.avg(F.when(F.col("fired") > 0, 1 / F.sqrt("fired")).otherwise(1.0)), F.lit(0.0))).alias("generalisation"))


def simplicity(net: Net) -> float:
    nodes = len(net.places) + len(net.transitions)
    return 1.0 if nodes == 0 else 1 / (1 + max(2 * len(net.arcs) / nodes - 2, 0))


def trace_differences(left: DataFrame, right: DataFrame, examples: int = 3) -> DataFrame:
    """side, variant: the shortest complete traces that only one of two tables of traces has; labels are compared trimmed and without case."""
    plain = lambda df: df.select(F.transform("variant", lambda x: F.lower(F.trim(x))).alias("variant")).distinct()
    a, b = plain(left), plain(right)
    one = lambda x, y, name: x.join(y, "variant", "left_anti").orderBy(F.size("variant"), "variant").limit(examples).select(F.lit(name).alias("side"), "variant")
    return one(a, b, "left").unionByName(one(b, a, "right"))


def trace_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: traces of both tables, traces in common, recall (share of left in right) and precision."""
    plain = lambda df: df.select(F.transform("variant", lambda x: F.lower(F.trim(x))).alias("variant")).distinct()
    a, b = plain(left), plain(right)
    both = a.join(b, "variant", "left_semi").agg(F.count("*").alias("common"))
    one = a.agg(F.count("*").alias("left_traces")).crossJoin(b.agg(F.count("*").alias("right_traces"))).crossJoin(both)  # one row each
    part = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col("common") / F.col(c))
    return one.withColumns({"recall": part("left_traces"), "precision": part("right_traces")})
