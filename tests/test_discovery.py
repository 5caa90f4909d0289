import random

import pytest
from pyspark.sql import functions as F

from helpers import L1, L3, NOISY, OPTIONAL, REPEATS, variants_of
from tracemill.operators import alpha, conformance, dfg, heuristics, inductive
from tracemill.plans import check_fit


def foot_of(table):
    g = dfg.dfg_of_variants(table)
    return dfg.footprint(g.nodes, g.edges), g


def alpha_net(table):
    foot, g = foot_of(table)
    return alpha.alpha_net(alpha.task_sets(g.nodes), alpha.place_pairs(foot))


def test_footprint(spark):
    rel = {(r["a"], r["b"]): r["relation"] for r in foot_of(variants_of(spark, L1))[0].collect()}
    assert (rel["a", "b"], rel["b", "c"], rel["b", "e"], rel["d", "b"]) == ("→", "‖", "#", "←")


def test_alpha_pairs(spark):
    foot, _ = foot_of(variants_of(spark, L1))
    pairs = alpha.place_pairs(foot).collect()
    assert len(pairs) == 10
    assert {(tuple(r["a"]), tuple(r["b"])) for r in pairs if r["maximal"]} == {(("a",), ("b", "e")), (("a",), ("c", "e")), (("b", "e"), ("d",)), (("c", "e"), ("d",))}
    answers = alpha.judge_place(spark.createDataFrame([(["a"], ["e", "b"]), (["a"], ["b"]), (["b"], ["c"])], "a array<string>, b array<string>"), foot, alpha.place_pairs(foot))
    assert {(tuple(r["a"]), tuple(r["b"])): r["answer"] for r in answers.collect()} == {(("a",), ("b", "e")): "yes", (("a",), ("b",)): "not maximal", (("b",), ("c",)): "a relation forbids it"}


def test_loop_warnings(spark):
    kinds = {r["kind"] for r in alpha.loop_warnings(variants_of(spark, REPEATS)).collect()}
    assert kinds == {"length one", "length two"}


def test_replay_of_alpha_net(spark):
    net = alpha_net(variants_of(spark, L1))
    fit = lambda text: conformance.replay_fitness(conformance.token_replay(variants_of(spark, text), net)).first()["fitness"]
    assert fit(L1) == 1.0
    assert fit(NOISY) == pytest.approx(0.9127, abs=1e-4)
    assert conformance.precision(variants_of(spark, L1), net).first()[0] == 1.0


@pytest.mark.parametrize("text,tree", [(L1, "→(a, ×(∧(b, c), e), d)"), (L3, "→(a, ↺(→(b, ∧(c, d), e), f), g)"), (OPTIONAL, "→(×(τ, ↺(load, τ)), unload)")])
def test_inductive_trees(spark, text, tree):
    assert str(inductive.inductive_miner(variants_of(spark, text))[0]) == tree


def test_inductive_alignments(spark):
    net = inductive.inductive_miner(variants_of(spark, L1))[0].net()
    aligned = conformance.align(variants_of(spark, NOISY), net)
    shortest = net.shortest_run()
    one = conformance.alignment_fitness(aligned, shortest).first()
    assert one["average_fitness"] == pytest.approx(0.9275, abs=1e-4)
    assert one["log_fitness"] == pytest.approx(0.9322, abs=1e-4)
    ed = aligned.filter(F.array_join("variant", ",") == "e,d").first()
    assert ed["cost"] == 1 and [m["kind"] for m in ed["moves"] if m["kind"] not in ("sync", "silent")] == ["model"]
    net3 = inductive.inductive_miner(variants_of(spark, L3))[0].net()
    assert conformance.precision(variants_of(spark, L3), net3).first()[0] == pytest.approx(0.8491, abs=1e-4)


def test_inductive_always_fits(spark):
    rng = random.Random(7)
    for _ in range(4):
        traces = ["<" + ",".join(rng.choice("abcde") for _ in range(rng.randint(0, 5))) + ">" for _ in range(6)]
        table = variants_of(spark, "[" + ", ".join(traces) + "]")
        net = inductive.inductive_miner(table)[0].net()
        assert conformance.replay_fitness(conformance.token_replay(table, net)).first()["fitness"] == 1.0


def test_bindings_and_heuristics_net(spark):
    table = variants_of(spark, L1)
    graph = heuristics.dependency_graph(table, 0.5)
    found = heuristics.bindings(table, graph)
    at = {(r["side"], r["activity"], tuple(r["binding"])): r["n"] for r in found.collect()}
    assert (at["out", "a", ("b", "c")], at["out", "a", ("e",)], at["in", "d", ("b", "c")], at["in", "d", ("e",)]) == (5, 1, 5, 1)
    net = heuristics.heuristics_net(found)
    aligned = conformance.align(table, net)
    assert conformance.alignment_fitness(aligned, net.shortest_run()).first()["average_fitness"] == 1.0
    assert conformance.precision(table, net).first()[0] == 1.0
    assert len(net.silent) == 2


def test_check_fit(spark):
    one = check_fit(variants_of(spark, L1), alpha_net(variants_of(spark, L1)), alignments=True).first()
    assert one["fitness"] == 1.0 and one["precision"] == 1.0 and 0 < one["simplicity"] <= 1 and 0 < one["generalisation"] < 1


def test_bootstrap_draws_cases_apart(spark):
    """Many variants of 9 cases: the fitness varies as over single cases, a ninth of the variance of whole variants."""
    from tracemill.operators.experiments import bootstrap_fitness

    rows = [([str(k)], 9, k % 2, 1, k % 2, 1) for k in range(200)]
    r = bootstrap_fitness(spark.createDataFrame(rows, "variant array<string>, n long, missing long, consumed long, remaining long, produced long"), 200, 3).first()
    assert abs(r["mean"] - 0.5) < 0.01 and 0.03 < r["high"] - r["low"] < 0.07


def test_frequency_model_reads_whole_cases(spark, tmp_path):
    """A user's day of 2500 events: what follows a view changes after the 1000th."""
    from tracemill import queries as Q

    follows = ["view", "click"] * 500 + ["view", "purchase"] * 750
    rows = spark.createDataFrame([(k, 1, x, float(k)) for k, x in enumerate(follows)], "event_id long, user_id long, event_type string, value double")
    rows.selectExpr("event_id", "user_id", "event_type", "value", "timestamp_seconds(1577836800 + event_id) AS ts").write.parquet(f"{tmp_path}/events.parquet")
    assert {r["last"]: r["predicted"] for r in Q.queries()["p6_frequency_model"](spark, str(tmp_path)).collect()}["view"] == "purchase"


def own_net():
    """A machine that is set up, works as often as it likes, and is checked while it is cleaned; setting up may be left out."""
    from tracemill.nets import Net

    net = Net()
    for name, first, last in (("in", 1, 0), ("ready", 0, 0), ("a", 0, 0), ("b", 0, 0), ("x", 0, 0), ("y", 0, 0), ("out", 0, 1)):
        net.place(name, first, last)
    net.transition("t1", "set up", ["in"], ["ready"])
    net.transition("t2", None, ["in"], ["ready"])
    net.transition("t3", "work", ["ready"], ["ready"])
    net.transition("t4", None, ["ready"], ["a", "b"])
    net.transition("t5", "check", ["a"], ["x"])
    net.transition("t6", "clean", ["b"], ["y"])
    net.transition("t7", None, ["x", "y"], ["out"])
    return net


def brute_cost(play, trace):
    """Least deviations by trying every order of moves, level by level."""
    level, deviations = {(0, play.begin)}, 0
    while True:
        seen = set(level)
        while level:  # moves that cost nothing
            level = {(k, m2) for k, m in level for t, m2 in play.moves(m) if play.labels[t] is None} | {(k + 1, m2) for k, m in level for t, m2 in play.moves(m) if k < len(trace) and play.labels[t] == trace[k]}
            level -= seen
            seen |= level
        if (len(trace), play.end) in seen:
            return deviations
        level = {(k + 1, m) for k, m in seen if k < len(trace)} | {(k, m2) for k, m in seen for t, m2 in play.moves(m) if play.labels[t] is not None}
        deviations += 1


def test_alignments_against_brute_force(spark):
    rng = random.Random(5)
    play = own_net().play()
    traces = [[rng.choice(["set up", "work", "check", "clean", "sing"]) for _ in range(rng.randint(0, 7))] for _ in range(60)]
    for trace in traces:
        cost, moves = play.align(trace)
        assert cost == brute_cost(play, trace)
        assert [m[0] for m in moves if m[0] is not None] == trace and cost == sum(m[3] in ("log", "model") for m in moves)
        marking = play.begin
        for _, _, name, kind in moves:
            if kind != "log":
                marking = dict(play.moves(marking))[play.names.index(name)]
        assert marking == play.end


def test_replay_by_hand(spark):
    """<work, clean>: set-up is skipped silently, the check lacks its token at the end; <clean, clean>: the second lacks one."""
    table = spark.createDataFrame([(["work", "check", "clean"], 2), (["work", "clean"], 1), (["clean", "clean", "check", "sing"], 1)], "variant array<string>, n long")
    rows = {",".join(r["variant"]): r for r in conformance.token_replay(table, own_net()).collect()}
    fits = rows["work,check,clean"]
    assert (fits["produced"], fits["consumed"], fits["missing"], fits["remaining"], fits["fits"]) == (8, 8, 0, 0, True)
    half = rows["work,clean"]
    assert (half["missing"], half["remaining"], half["missing_at"], half["remaining_at"], half["problems"]) == (1, 2, {"out": 1}, {"a": 1, "y": 1}, [])
    twice = rows["clean,clean,check,sing"]
    assert twice["missing_at"] == {"b": 1} and twice["remaining_at"] == {"y": 1} and twice["unknown"] == ["sing"] and twice["problems"] == [1, 3] and not twice["fits"]


def test_ranges_against_sorting(spark, monkeypatch):
    """Ranks, running sums and quantiles over many partitions, with ties and nulls, against sorting in one place."""
    import statistics

    from tracemill.operators import ranges

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([None, *map(float, range(30))]), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, x double, k long").repartition(7)
    ranked = {r["k"]: r["place"] for r in ranges.with_rank(df, [F.col("x").asc_nulls_first(), F.col("k")], "place").collect()}
    assert ranked == {k: i for i, (_, _, k) in enumerate(sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])))}
    q = {r["g"]: (r["low"], r["mid"]) for r in ranges.quantiles(df, ["g"], "x", {"low": 0.25, "mid": 0.5}).collect()}
    for g in "ab":
        x = [v for h, v, _ in rows if h == g and v is not None]
        assert q[g][1] == statistics.median(x) and q[g][0] == pytest.approx(statistics.quantiles(x, n=4, method="inclusive")[0])


def test_alignments_of_many_concurrent_steps(spark):
    """A net of 2^12 markings and a bound of 900: what the trace itself reaches is little, so costs are exact."""
    from tracemill.nets import Net

    names = [f"s{k}" for k in range(12)]
    net = Net()
    net.place("in", first=1)
    net.place("out", last=1)
    for n in names:
        net.place(f"a{n}")
        net.place(f"b{n}")
    net.transition("fork", None, ["in"], [f"a{n}" for n in names])
    for n in names:
        net.transition(n, n, [f"a{n}"], [f"b{n}"])
    net.transition("join", None, [f"b{n}" for n in names], ["out"])
    play = net.play()
    rng = random.Random(3)
    assert play.run_cost(900) == (float("inf"), float("inf")) and play.run_cost() == (12, 2)
    for extra in ([], ["sing"], ["s3"]):
        trace = rng.sample(names, 12)
        for x in extra:
            trace.insert(rng.randint(0, 12), x)
        cost, moves = play.align(trace, most=900)
        assert cost == len(extra) and sum(m[3] in ("log", "model") for m in moves) == cost
    assert play.align(names[:6], most=900)[0] in (None, 6)
