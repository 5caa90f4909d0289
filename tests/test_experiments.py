"""Resampling, tests of samples, time frames, digests of long cases and large files, and what discovery gives on small logs."""

import hashlib
import itertools
import random
from collections import Counter
from statistics import mean

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import L1, OPTIONAL, REPEATS, variants_of
from tracemill import sources as S
from tracemill.log import BY_NAME_COMPLETE, log_from_table
from tracemill.operators import conformance, experiments, filters, heuristics, inductive, prediction, ranges
from tracemill.operators.variants import digest_of, sequence_digests, variant_counts, variants


@pytest.mark.parametrize("fan_out", [2, 3, 1024])
def test_resampled_logs_have_the_size_of_the_log(spark, fan_out):
    counts = [7, 1, 30, 2, 2, 1, 50, 9]
    table = spark.createDataFrame(list(enumerate(counts)), "place long, n long")
    drawn = experiments.resampled_counts(table, 300, 5, fan_out)
    rows = drawn.collect()
    per_sample = Counter()
    for r in rows:
        per_sample[r["sample"]] += r["w"]
    assert len(per_sample) == 300 and set(per_sample.values()) == {sum(counts)}
    total = sum(counts)
    for place, n in enumerate(counts):  # means and variances of a multinomial, within about five standard errors
        w = [next((r["w"] for r in rows if r["sample"] == s and r["place"] == place), 0) for s in range(1, 301)]
        sd = (total * n / total * (1 - n / total)) ** 0.5
        assert abs(mean(w) - n) < 5 * sd / 300**0.5 and 0.75 * sd < np.std(w) < 1.25 * sd
    assert sorted(map(tuple, experiments.resampled_counts(table, 300, 5, fan_out).collect())) == sorted(map(tuple, rows))


def test_interval_against_resampling_by_hand(spark):
    rng = random.Random(4)
    rows = [([str(k)], rng.randint(1, 9), k % 3, 10, k % 2, 12) for k in range(40)]
    df = spark.createDataFrame(rows, "variant array<string>, n long, missing long, consumed long, remaining long, produced long")
    found = experiments.resampled_fitness(df, 400, 1).first()
    cases = [r for r in rows for _ in range(r[1])]
    values = []
    for _ in range(2000):
        picked = [rng.choice(cases) for _ in cases]
        values.append(0.5 * (1 - sum(r[2] for r in picked) / sum(r[3] for r in picked)) + 0.5 * (1 - sum(r[4] for r in picked) / sum(r[5] for r in picked)))
    low, high = np.percentile(values, [2.5, 97.5])
    assert abs(found["mean"] - mean(values)) < 0.001 and abs(found["low"] - low) < 0.003 and abs(found["high"] - high) < 0.003


def enumerated(x, y):
    """Two-sided p of U over all ways to choose the first sample."""
    u = lambda a, b: sum((i > j) for i in a for j in b)
    pool, n = x + y, len(x) * len(y)
    far, hits, total = max(u(x, y), n - u(x, y)), 0, 0
    for chosen in itertools.combinations(range(len(pool)), len(x)):
        a = [pool[k] for k in chosen]
        b = [pool[k] for k in range(len(pool)) if k not in chosen]
        hits, total = hits + (u(a, b) >= far), total + 1
    return min(1.0, 2 * hits / total)


def test_exact_u_against_enumeration():
    rng = random.Random(6)
    for n1, n2 in [(1, 1), (1, 5), (2, 3), (4, 4), (3, 7), (5, 5)]:
        for _ in range(3):
            values = rng.sample(range(100), n1 + n2)
            x, y = values[:n1], values[n1:]
            u = sum(i > j for i in x for j in y)
            assert experiments.exact_u_tail(u, n1, n2) == pytest.approx(enumerated(x, y))
    assert experiments.exact_u_tail(0, 8, 8) == pytest.approx(2 / 12870)


def test_comparison_in_words(spark):
    rows = [("old", float(v)) for v in (1, 2, 3, 4, 5)] + [("young", float(v)) for v in (11, 12, 13, 14, 15)]
    one = experiments.comparison(spark.createDataFrame(rows, "g string, v double"), "g", "v").first()
    assert (one["u"], one["exact"], one["differ"], one["verdict"]) == (0.0, True, True, "young is higher") and one["p_u"] == pytest.approx(2 / 252)
    tied = experiments.comparison(spark.createDataFrame(rows[:3] + [("young", 2.0), ("young", 3.0)], "g string, v double"), "g", "v").first()
    assert (tied["exact"], tied["differ"], tied["verdict"]) == (False, False, "no difference")


def test_an_end_without_time_is_the_whole_day(spark):
    rows = spark.createDataFrame([("a", "x", "2024-01-05 00:00:00"), ("b", "x", "2024-01-05 23:59:59.999999"), ("c", "x", "2024-01-06 00:00:00"), ("d", "x", "2024-01-03 12:00:00")], "case_id string, activity string, t string")
    log = log_from_table(rows.withColumn("ts", F.to_timestamp("t")), "case_id", "activity", "ts")
    kept = lambda end, mode="contained": {r["case_id"] for r in filters.time_frame(log, "2024-01-04", end, mode).cases.collect()}
    assert kept("2024-01-05") == kept("2024-01-05", "started") == kept("2024-01-05", "intersecting") == {"a", "b"}
    assert kept("2024-01-05 00:00:00") == {"a"}


def test_sequence_digests_are_those_of_arrays(spark, monkeypatch):
    rng = random.Random(8)
    made = [(f"c{k % 90}", rng.choice(["a", "b", "é", ""]), k, rng.choice(["start", "complete", None])) for k in range(700)] + [("long", "ab"[k % 2], k, "complete") for k in range(5000)]
    log = log_from_table(spark.createDataFrame(made, "case_id string, activity string, k long, l string"), "case_id", "activity", lifecycle="l", order_by=["k"])
    from tracemill.operators.variants import sequences

    for limit in (ranges.HOT, 1000):
        monkeypatch.setattr(ranges, "HOT", limit)
        for classifier in (BY_NAME_COMPLETE, None):
            some = [classifier] if classifier else []
            want = {r["case_id"]: r["d"] for r in sequences(log, *some).select("case_id", digest_of(F.col("variant")).alias("d")).collect()}
            assert {r["case_id"]: r["digest"] for r in sequence_digests(log, *some).collect()} == want
    by_digest = sorted((r["length"], r["n"]) for r in variant_counts(log).collect())
    assert by_digest == sorted((len(r["variant"]), r["n"]) for r in variants(log).collect())


def test_digest_of_a_very_long_case(spark):
    """Millions of events of one case: their sums are those of a plain loop over the places."""
    n = 2_000_000
    rows = spark.range(n).select(F.lit("one").alias("case_id"), F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("activity"), F.lit(None).cast("string").alias("lifecycle"))
    from tracemill.log import EventLog
    from tracemill.operators.variants import MODULI

    log = EventLog(spark.createDataFrame([("one", 0)], "case_id string, first int"), rows)
    found = sequence_digests(log).first()["digest"]
    want = [str(n)]
    for k, (m, b) in enumerate(MODULI):
        code = {x: 1 + int(hashlib.sha256(x.encode()).hexdigest()[7 * k : 7 * k + 7], 16) for x in "ab"}
        total, power = 0, 1
        for i in range(n):
            total += code["a" if i % 3 == 0 else "b"] * power % m
            power = power * b % m
        want.append(str(total % m))
    assert found == "-".join(want)


@pytest.mark.parametrize("tail", [b"", b"\n", b"\n\n"])
def test_files_larger_than_a_row(spark, tmp_path, tail):
    rng = random.Random(9)
    contents = {"small": b"few", "large": bytes(rng.randrange(256) for _ in range(200_000)) + tail, "lines": b"\n" * 70_000 + b"x" + tail}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        found = {r["path"].rpartition("/")[2]: (r["length"], r["sha256"]) for r in S.fingerprints(spark, str(tmp_path), row_bytes=10_000).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in contents.items()}


TREES = [
    ("[<tie>^3]", "tie"), ("[<>^2]", "τ"), ("[<tie>^2, <>]", "×(τ, tie)"), ("[<tie>, <tie,tie>]", "↺(tie, τ)"), ("[<tie>, <glue>^2]", "×(glue, tie)"),
    ("[<cut,tie>^2]", "→(cut, tie)"), ("[<cut,tie>, <tie,cut>]", "∧(cut, tie)"), ("[<cut>, <cut,mend,cut>]", "↺(cut, mend)"),
    ("[<cut,glue,tie>, <cut,tie>]", "→(cut, ×(τ, glue), tie)"), ("[<cut,glue,sand,tie>, <cut,sand,glue,tie>]", "→(cut, ∧(glue, sand), tie)"), (OPTIONAL, "→(×(τ, ↺(load, τ)), unload)"),
]


@pytest.mark.parametrize("log,tree", TREES)
def test_trees_of_small_logs(spark, log, tree):
    """Base cases, each cut, and empty traces inside a cut."""
    assert str(inductive.inductive_miner(variants_of(spark, log))[0]) == tree


def accepted(spark, net, alphabet, most):
    """The traces up to a length that the net can replay from start to end without a deviation."""
    every = [list(t) for n in range(most + 1) for t in itertools.product(alphabet, repeat=n)]
    table = spark.createDataFrame([(t, 1) for t in every], "variant array<string>, n long")
    return {",".join(r["variant"]) for r in conformance.align(table, net).filter("cost = 0").collect()}


def test_language_of_the_heuristics_net(spark):
    table = variants_of(spark, L1)
    net = heuristics.heuristics_net(heuristics.bindings(table, heuristics.dependency_graph(table, 0.5)))
    assert accepted(spark, net, "abcde", 4) == {"a,b,c,d", "a,c,b,d", "a,e,d"}


def test_language_of_the_inductive_net(spark):
    assert accepted(spark, inductive.inductive_miner(variants_of(spark, L1))[0].net(), "abcde", 4) == {"a,b,c,d", "a,c,b,d", "a,e,d"}
    loop = inductive.inductive_miner(variants_of(spark, "[<p>, <p,q,p>]"))[0].net()
    assert accepted(spark, loop, "pq", 5) == {"p", "p,q,p", "p,q,p,q,p"}


def test_forest_learns_what_decides(spark):
    """The last activity decides what comes next, and the number of steps the time that is left."""
    after = {"a": "b", "b": "c", "c": "a"}
    rows = [([*"abc" * 3][k % 3 : k % 3 + 1 + k % 4], k) for k in range(240)]
    df = spark.createDataFrame([(p, len(p), after[p[-1]], 10.0 * len(p)) for p, _ in rows], "prefix array<string>, prefix_length int, next_activity string, left double")
    made = prediction.frequency_features(df, ["a", "b", "c"])
    names = [c for c in made.columns if c not in df.columns]
    model = prediction.forest(made, names, "next_activity", trees=15)
    scores = {r["prefix_length"]: r["score"] for r in prediction.evaluate(model.transform(made), "next_activity").collect()}
    assert scores == {None: 1.0, 1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0}
    error = prediction.evaluate(prediction.forest(made, names, "left", trees=15).transform(made), "left").filter("prefix_length is null").first()["score"]
    assert error < 1.5


def test_forest_makes_its_rows_once(spark):
    """Fitting goes over the rows several times; what they follow from is done once."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        made.add(1)
        return x

    df = spark.range(200).select(counted((F.col("id") % 3).cast("int")).alias("x"), F.concat(F.lit("after "), (F.col("id") % 3).cast("string")).alias("next_activity"))
    model = prediction.forest(df, ["x"], "next_activity", trees=3)
    assert made.value == 200
    assert model.transform(df).filter("predicted <> next_activity").count() == 0


def test_loops_are_told_in_dependencies(spark):
    found = {(r["a"], r["b"]): (r["n"], round(r["value"], 6)) for r in heuristics.two_loops(variants_of(spark, REPEATS)).collect()}
    assert found == {("ask", "check"): (1, 0.5)}


def test_graphs_without_an_activity(spark):
    """From triples of runs, as from the log with the activity taken out."""
    rng = random.Random(10)
    logs = spark.createDataFrame([(rng.choice(["0", "0.1"]), [rng.choice("abcd") for _ in range(rng.randint(0, 7))], rng.randint(1, 3)) for _ in range(60)], "node string, variant array<string>, n long")
    graphs, without = inductive._graphs(logs), inductive.Without(logs, ["0", "0.1"])
    for x in "abcd":
        plain = inductive._graphs(logs.withColumn("variant", F.array_remove("variant", x)))
        for node in ("0", "0.1"):
            assert without.graph(node, graphs[node]["graph"], x) == plain[node]["graph"]


def test_large_alphabets(spark):
    """Two thousand activities in a row, the middle ones in any order: one sequence with one parallel part."""
    names = [f"a{k:04d}" for k in range(2000)]
    one = names[:1000] + ["p", "q"] + names[1000:]
    two = names[:1000] + ["q", "p"] + names[1000:]
    tree, _ = inductive.inductive_miner(spark.createDataFrame([(one, 3), (two, 1)], "variant array<string>, n long"))
    assert tree.operator == inductive.SEQUENCE and len(tree.children) == 2001 and str(tree.children[1000]) == "∧(p, q)"


def split_by_hand(variant, kind, groups):
    """(child, sub-trace) of one trace."""
    if kind in ("rest", "drop"):
        return [(0, variant)] if variant else []
    if kind == inductive.XOR:
        k = max(range(len(groups)), key=lambda k: (sum(a in groups[k] for a in variant), -k))
        return [(k, [a for a in variant if a in groups[k]])]
    if kind in (inductive.SEQUENCE, inductive.PARALLEL):
        return [(k, [a for a in variant if a in g]) for k, g in enumerate(groups)]
    out = []
    if kind == inductive.LOOP:
        for a in variant:
            k = next((k for k, g in enumerate(groups) if a in g), 0)
            if out and out[-1][0] == k:
                out[-1][1].append(a)
            else:
                out += [(0, [])] * (k > 0 and (not out or out[-1][0] > 0)) + [(k, [a])]
        return out if out and out[-1][0] == 0 else [*out, (0, [])]
    at = [0, *(i for i in range(1, len(variant)) if [variant[i - 1], variant[i]] in groups), len(variant)]
    return [(0, variant[x:y]) for x, y in zip(at, at[1:])] if variant else [(0, [])]


@pytest.mark.parametrize("kind,groups", [
    ("rest", None), ("drop", None), (inductive.XOR, [["a", "c"], ["b", "d"]]), (inductive.SEQUENCE, [["b"], ["a", "d"], ["c"]]), (inductive.PARALLEL, [["a"], ["b", "c", "d"]]),
    (inductive.LOOP, [["a", "b"], ["c"], ["d"]]), ("cut at", [["a", "b"], ["b", "b"], ["c", "a"]]),
])
def test_sublogs_by_hand(spark, kind, groups):
    rng = random.Random(11)
    rows = [(rng.choice(["0", "0.3"]), [rng.choice("abcd") for _ in range(rng.randint(0, 6))], rng.randint(1, 3)) for _ in range(80)]
    plan = (kind,) if groups is None else (kind, groups)
    want = Counter()
    for node, variant, n in rows:
        for k, piece in split_by_hand(variant, kind, groups):
            want[f"{node}.{k}", ",".join(piece)] += n
    found = inductive.split_logs(spark.createDataFrame(rows, "node string, variant array<string>, n long"), {"0": plan, "0.3": plan, "0.9": plan})
    assert {(r["node"], ",".join(r["variant"])): r["n"] for r in found.collect()} == want
