"""Resampling, tests, parameter grids, noise and fingerprints."""

from __future__ import annotations

import itertools
import math
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..log import EventLog
from ..runtime import cut
from .ranges import with_rank, with_sum_before


def _unit(key: Column, seed: int, k: int) -> Column:
    """A number between 0 and 1 that follows from a key: 32 bits of its SHA-256."""
    return (F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(str(seed)), F.lit(str(k))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def bootstrap_fitness(replayed: DataFrame, samples: int = 200, seed: int = 0) -> DataFrame:
    """One row: mean, low and high (2.5 and 97.5 %) of the replay fitness over resampled logs whose size varies as chance has it.

    A resampled count per variant is drawn from a normal approximation of the Poisson bootstrap of its cases where
    it has many, and from the Poisson distribution of that mean else; replay itself is done once.
    """
    each = replayed.select("n", "missing", "consumed", "remaining", "produced", F.array_join("variant", ",").alias("v"))
    drawn = each.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    unit = lambda k: _unit(F.concat_ws("|", "v", F.col("sample").cast("string")), seed, k)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * math.pi * unit(2))
    steps = F.array(*(F.array(*map(F.lit, _poisson_steps(float(n), 40))) for n in range(1, 10)))
    poisson = F.size(F.filter(F.get(steps, F.col("n").cast("int") - 1), lambda t: t < unit(3))).cast("double")
    weight = F.when(F.col("n") >= 10, F.greatest(F.round(F.col("n") + normal * F.sqrt("n")), F.lit(0.0))).otherwise(poisson)
    drawn = drawn.withColumn("w", weight)
    return _interval(drawn)


def _interval(drawn: DataFrame) -> DataFrame:
    """mean, low and high of the fitness of samples: rows of a variant's tokens with its count w in a sample."""
    sums = drawn.groupBy("sample").agg(*(F.sum(F.col(k) * F.col("w")).alias(k) for k in ("missing", "consumed", "remaining", "produced")))
    part = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(1 - F.col(a) / F.col(b))
    fit = sums.select((0.5 * part("missing", "consumed") + 0.5 * part("remaining", "produced")).alias("f"))
    return fit.agg(F.avg("f").alias("mean"), F.percentile("f", F.lit(0.025)).alias("low"), F.percentile("f", F.lit(0.975)).alias("high"))


def _splitter(seed: int, depth: int):
    """Deals the draws of a node in each sample to its children."""

    def split(key: tuple[pa.Scalar, ...], kids: pa.Table, above: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(kids.column("place")))
        place, cases = (np.asarray(kids.column(c))[order] for c in ("place", "cases"))
        out = []
        for sample, w in zip(above.column("sample").to_pylist(), above.column("w").to_pylist()):
            rng = np.random.default_rng([seed, depth, key[0].as_py(), sample])
            left, below = w, int(cases.sum())
            for p, c in zip(place.tolist(), cases.tolist()):
                if not left:
                    break
                k = left if c == below else int(rng.binomial(left, c / below))
                left, below = left - k, below - c
                if k:
                    out.append((p, sample, k))
        columns = zip(*out) if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()))], ["node", "sample", "w"])

    return split


def resampled_counts(table: DataFrame, samples: int, seed: int = 0, fan_out: int = 1024) -> DataFrame:
    """place and sample with w: how often each of the table's rows (place, n) is drawn when as many cases as there are are drawn with replacement; zeros are left out.

    The draws are multinomial. They go down a tree: at each node the draws of a sample are split among at most
    ``fan_out`` children in proportion to the cases below them, by one binomial draw after another, so every sample has exactly as
    many cases as the log, and no task sees more than one node's children. A node's draws follow from the seed, the node and its level.
    """
    levels = [cut(table.select("place", F.col("n").alias("cases")), "tree")]
    while levels[-1].count() > fan_out:
        up = levels[-1].groupBy(F.expr(f"place div {fan_out}").alias("place")).agg(F.sum("cases").alias("cases"))
        levels.append(cut(up, "tree"))
    total = levels[-1].agg(F.sum("cases")).first()[0] or 0
    spark = table.sparkSession
    drawn = spark.range(1, samples + 1).select(F.lit(0).cast("long").alias("node"), F.col("id").cast("int").alias("sample"), F.lit(total).cast("long").alias("w"))
    for depth, level in enumerate(reversed(levels)):
        node = F.lit(0).cast("long") if depth == 0 else F.expr(f"place div {fan_out}")

        kids = level.withColumn("of", node)
        drawn = cut(kids.groupBy("of").cogroup(drawn.groupBy("node")).applyInArrow(_splitter(seed, depth), "node long, sample int, w long"), "drawn")
    return drawn.withColumnRenamed("node", "place")


def resampled_fitness(replayed: DataFrame, samples: int = 200, seed: int = 0) -> DataFrame:
    """One row: mean, low and high (2.5 and 97.5 %) of the replay fitness over logs of the same size, drawn case by case with replacement; replay is done once."""
    placed = cut(with_rank(replayed.select("n", "missing", "consumed", "remaining", "produced", F.array_join("variant", ",").alias("v")), [F.col("v")], "place"), "resampled")
    return _interval(resampled_counts(placed, samples, seed).join(placed, "place"))


def _poisson_steps(mean: float, most: int = 8) -> list[float]:
    """Cumulative probabilities of 0, 1, ... events."""
    total, out = 0.0, []
    for k in range(most):
        total += math.exp(-mean) * mean**k / math.factorial(k)
        out.append(total)
    return out


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def student_tail(t: float, df: float) -> float:
    """Two-sided p of Student's t by numerical integration of its density."""
    if df <= 0 or math.isnan(t):
        return float("nan")
    scale = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    top, steps = abs(t), 4000
    h = top / steps if top else 0.0
    f = lambda x: scale * (1 + x * x / df) ** (-(df + 1) / 2)
    area = h / 3 * (f(0) + f(top) + sum((4 if k % 2 else 2) * f(k * h) for k in range(1, steps))) if h else 0.0
    return max(0.0, 1 - 2 * area)


def exact_u_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties: the share of all orders of n1 and n2 values whose U is as far from the middle; counted rank by rank."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1), dtype=object)  # how many choices of k values, by the U they give
    ways[0, 0] = 1
    for rank in range(n1 + n2):
        for k in range(min(n1, rank + 1), 0, -1):  # the k-th chosen value has rank - k + 1 of the others below it
            step = rank - k + 1
            if step <= n2:
                ways[k, step:] += ways[k - 1, : n1 * n2 + 1 - step]
    far = max(u, n1 * n2 - u)
    return min(1.0, 2 * float(Fraction(int(ways[n1, math.ceil(far) :].sum()), int(ways[n1].sum()))))


#: Most pairs of values for which the exact distribution of U is counted, and the size of the smaller sample up to which it is asked for.
EXACT_PAIRS, EXACT_SIZE = 100_000, 8


def mann_whitney(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: u of the smaller group name, counts, whether there are ties, and tie-corrected z; ranks are averages over ties.

    Values are counted first, so that the ordered table has one row per distinct value.
    """
    names = F.array_sort(F.collect_set(group))
    first = df.agg(names[0].alias("g0"))
    counted = df.crossJoin(F.broadcast(first)).groupBy(value).agg(F.count("*").alias("t"), F.count_if(F.col(group) == F.col("g0")).alias("k"))
    ranked = with_sum_before(counted, [F.col(value)], "t", "below").withColumn("rank", F.col("below") + (F.col("t") + 1) / 2)
    one = ranked.agg(F.sum(F.col("rank") * F.col("k")).alias("r"), F.sum("k").alias("n1"), (F.sum("t") - F.sum("k")).alias("n2"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).cast("double").alias("ties"))
    n = F.col("n1") + F.col("n2")
    u = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    return one.select(u.alias("u"), "n1", "n2", (F.col("ties") > 0).alias("tied"), ((F.abs(u - F.col("n1") * F.col("n2") / 2) - 0.5) / sd).alias("z"))


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: t, degrees of freedom, and both means, groups by name."""
    each = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))
    pair = each.agg(F.array_sort(F.collect_list(F.struct(F.col(group).alias("g"), "n", "mean", "var"))).alias("x"))
    a, b = F.col("x")[0], F.col("x")[1]
    va, vb = a["var"] / a["n"], b["var"] / b["n"]
    return pair.select(((a["mean"] - b["mean"]) / F.sqrt(va + vb)).alias("t"), ((va + vb) * (va + vb) / (va * va / (a["n"] - 1) + vb * vb / (b["n"] - 1))).alias("df"), a["mean"].alias("mean_a"), b["mean"].alias("mean_b"))


def compare_samples(df: DataFrame, group: str, value: str) -> dict:
    """Statistics, two-sided p-values and verdict of both tests. The p of U is exact for small samples without ties, else that of its normal approximation."""
    m, w = mann_whitney(df, group, value).first(), welch(df, group, value).first()
    exact = not m["tied"] and min(m["n1"], m["n2"]) <= EXACT_SIZE and m["n1"] * m["n2"] <= EXACT_PAIRS
    p_u = exact_u_tail(m["u"], m["n1"], m["n2"]) if exact else normal_tail(max(0.0, m["z"]))
    p_t = student_tail(w["t"], w["df"])
    return {"u": m["u"], "n1": m["n1"], "n2": m["n2"], "p_u": p_u, "exact": exact, "t": w["t"], "p_t": p_t, "mean_a": w["mean_a"], "mean_b": w["mean_b"], "differ": p_u < 0.05}


def comparison(df: DataFrame, group: str, value: str) -> DataFrame:
    """``compare_samples`` as one row, with the verdict in words: which of the two groups is higher, or that the test sees no difference."""
    found = compare_samples(df, group, value)
    names = sorted(r[0] for r in df.select(group).distinct().limit(3).collect())
    higher = names[0] if found["mean_a"] > found["mean_b"] else names[1]
    verdict = f"{higher} is higher" if found["differ"] else "no difference"
    return df.sparkSession.createDataFrame([(*found.values(), verdict)], "u double, n1 long, n2 long, p_u double, exact boolean, t double, p_t double, mean_a double, mean_b double, differ boolean, verdict string")


def parse_values(text: str) -> list:
    """'0..0.4 step 0.2' or 'a, b'."""
    m = re.fullmatch(r"\s*(-?[\d.]+?)\s*\.\.\s*(-?[\d.]+)\s*(?:step\s*(-?[\d.]+))?\s*", text)
    if not m:
        return [x.strip() for x in text.split(",") if x.strip()]
    whole = all(re.fullmatch(r"-?\d+", x or "1") for x in m.groups())
    low, high, step = float(m[1]), float(m[2]), float(m[3] or 1)
    n = math.floor((high - low) / step + 1e-9) if step else -1
    if n < 0:
        raise ValueError(f"no values in {text!r}")
    return [int(low + k * step) if whole else round(low + k * step, 12) for k in range(n + 1)]


def parameter_grid(spark: SparkSession, **values) -> DataFrame:
    """One row per combination of parameter values."""
    rows = list(itertools.product(*values.values()))
    return spark.createDataFrame(rows, list(values))


def dependency_sweep(dependencies: DataFrame, grid: DataFrame) -> DataFrame:
    """threshold, edges: how many dependency edges each threshold of the grid keeps; the grid is small."""
    return F.broadcast(grid).crossJoin(dependencies.select("value")).groupBy("threshold").agg(F.count_if(F.col("value") >= F.col("threshold")).alias("edges"))


def add_noise(log: EventLog, probability: float, seed: int = 0) -> EventLog:
    """Cases lose one event, never the first, or have two neighbours swapped, with the given probability; ``damaged`` marks them. Draws are hashes of the case."""
    sizes = log.events.groupBy("case_id").agg(F.count("*").alias("size"))
    unit = lambda k: _unit(F.col("case_id"), seed, k)
    draw = sizes.withColumns({"hit": (unit(1) < probability) & (F.col("size") > 1), "drop": unit(2) < 0.5, "place": F.floor(unit(3) * (F.col("size") - 1)).cast("int")})
    rows = log.events.join(draw, "case_id")
    kept = rows.filter(~(F.col("hit") & F.col("drop") & (F.col("pos") == F.col("place") + 1)))
    swap = F.col("hit") & ~F.col("drop")
    moved = F.when(swap & (F.col("pos") == F.col("place")), F.col("pos") + 1).when(swap & (F.col("pos") == F.col("place") + 1), F.col("pos") - 1).otherwise(F.col("pos"))
    own = W.partitionBy("case_id").orderBy("moved")
    events = kept.withColumn("moved", moved).withColumn("pos", F.row_number().over(own) - 1).select(log.events.columns)
    cases = log.cases.join(draw.select("case_id", F.col("hit").alias("damaged")), "case_id", "left").fillna(False, ["damaged"])
    return EventLog(cases, events, log.meta)


def log_fingerprint(log: EventLog, digits: int = 3) -> DataFrame:
    """One row: a digest of case ids, activities and times in order; built case by case, then per bucket (16^digits of them), then in all."""
    event = F.concat_ws("|", F.coalesce("activity", F.lit("")), F.coalesce(F.unix_micros("ts").cast("string"), F.lit("")))
    per_case = log.events.groupBy("case_id").agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("pos", event.alias("e")))), lambda x: x["e"])), 256).alias("h"))
    rows = log.cases.select("case_id").join(per_case, "case_id", "left").select(F.substring(F.sha2("case_id", 256), 1, digits).alias("bucket"), F.concat_ws("=", "case_id", F.coalesce("h", F.lit(""))).alias("h"))
    per_bucket = rows.groupBy("bucket").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("h"))), 256).alias("h"))
    return per_bucket.agg(F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x["h"])), 256).alias("fingerprint"))


def changed(before: DataFrame, after: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """name, a, b of recorded values that differ between two tables."""
    both = before.select(key, F.col(value).alias("a")).join(after.select(key, F.col(value).alias("b")), key, "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))
