"""Queries on discovery, transition systems, conformance, prediction and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import nets
from ..operators import alpha, conformance, experiments, heuristics, inductive, prediction, transitions
from ..operators import dfg as G
from ..operators.variants import variants
from ..plans import check_fit
from ..runtime import cut
from .base import CONV, EDGES, LINES, USER, USERDAY, conversations, half_month, order_lines, query, rounded, table, text, user_days, users


@query(f"WITH {CONV}, {EDGES} SELECT (SELECT string_agg(activity, ',' ORDER BY activity) FROM nodes) AS t_l, (SELECT string_agg(activity, ',' ORDER BY activity) FROM nodes WHERE n_start > 0) AS t_i, (SELECT string_agg(activity, ',' ORDER BY activity) FROM nodes WHERE n_end > 0) AS t_o")
def d1_task_sets(spark, d):
    return alpha.task_sets(G.discover_dfg(conversations(spark, d)).nodes).select(*(text(c).alias(c) for c in ("t_l", "t_i", "t_o")))


def _conversation_foot(spark, d):
    g = G.discover_dfg(conversations(spark, d))
    return G.footprint(g.nodes, g.edges), g


#: Place pairs by enumeration: sets of activities as bit masks, kept if no pair inside is ordered and all across are.
PLACES = f"""{CONV}, {EDGES}, acts AS (SELECT activity, row_number() OVER (ORDER BY activity) - 1 AS i FROM nodes),
rel AS (SELECT x.i AS i, y.i AS j, x.activity AS a, y.activity AS b, EXISTS (SELECT 1 FROM edges e WHERE e.a = x.activity AND e.b = y.activity) AS f, EXISTS (SELECT 1 FROM edges e WHERE e.a = y.activity AND e.b = x.activity) AS g FROM acts x, acts y),
masks AS (SELECT unnest(range(1, 1::BIGINT << (SELECT count(*) FROM acts))) AS m),
sets AS (SELECT m, (SELECT string_agg(activity, ',' ORDER BY activity) FROM acts WHERE (m >> i) & 1 = 1) AS names FROM masks WHERE NOT EXISTS (SELECT 1 FROM rel WHERE (f OR g) AND (m >> i) & 1 = 1 AND (m >> j) & 1 = 1)),
xl AS (SELECT p.m AS pm, q.m AS qm, p.names AS a, q.names AS b FROM sets p, sets q WHERE NOT EXISTS (SELECT 1 FROM rel WHERE NOT (f AND NOT g) AND (p.m >> i) & 1 = 1 AND (q.m >> j) & 1 = 1)),
pairs AS (SELECT a, b, NOT EXISTS (SELECT 1 FROM xl o WHERE (o.pm & x.pm) = x.pm AND (o.qm & x.qm) = x.qm AND (o.pm <> x.pm OR o.qm <> x.qm)) AS maximal FROM xl x)"""


@query(f"WITH {PLACES} SELECT a, b, maximal FROM pairs")
def d2_place_pairs(spark, d):
    return alpha.place_pairs(_conversation_foot(spark, d)[0]).select(text("a").alias("a"), text("b").alias("b"), "maximal")


@query(f"""WITH {PLACES}, pl AS (SELECT 'p({{' || a || '}},{{' || b || '}})' AS p, a, b FROM pairs WHERE maximal)
SELECT 'net' AS net_id, unnest(string_split(a, ',')) AS source, p AS target, 1::INT AS weight FROM pl UNION ALL SELECT 'net', p, unnest(string_split(b, ',')), 1 FROM pl
UNION ALL SELECT 'net', 'i_L', activity, 1 FROM nodes WHERE n_start > 0 UNION ALL SELECT 'net', activity, 'o_L', 1 FROM nodes WHERE n_end > 0""")
def d3_alpha_net(spark, d):
    foot, g = _conversation_foot(spark, d)
    return alpha.alpha_net(alpha.task_sets(g.nodes), alpha.place_pairs(foot)).tables(spark)[2]


@query(f"""WITH {CONV}, t AS (SELECT activity AS x, lead(activity) OVER w AS y, lead(activity, 2) OVER w AS z FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos))
SELECT DISTINCT 'length one' AS kind, x AS a, NULL AS b FROM t WHERE x = y UNION SELECT DISTINCT 'length two', least(x, y), greatest(x, y) FROM t WHERE x = z AND x <> y""")
def d4_loop_warnings(spark, d):
    return alpha.loop_warnings(variants(conversations(spark, d)))


@query(f"""WITH {PLACES} SELECT r.a, r.b, CASE WHEN p.maximal THEN 'yes' WHEN NOT p.maximal THEN 'not maximal' ELSE 'a relation forbids it' END AS answer
FROM rel r LEFT JOIN pairs p ON p.a = r.a AND p.b = r.b WHERE r.a <> r.b""")
def d5_judge_place(spark, d):
    foot, _ = _conversation_foot(spark, d)
    pairs = alpha.place_pairs(foot)
    every = foot.filter("a <> b").select(F.array("a").alias("a"), F.array("b").alias("b"))
    return alpha.judge_place(every, foot, pairs).select(text("a").alias("a"), text("b").alias("b"), "answer")


DEPS = "deps AS (SELECT s.a, s.b, s.n, CASE WHEN s.a = s.b THEN s.n * 1.0 / (s.n + 1) ELSE (s.n - coalesce(t.n, 0)) * 1.0 / (s.n + coalesce(t.n, 0) + 1) END AS value FROM edges s LEFT JOIN edges t ON s.a = t.b AND s.b = t.a)"
TWO = """tw AS (SELECT a, b, count(*) AS n FROM (SELECT activity AS a, lead(activity) OVER w AS b, lead(activity, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos)) WHERE a = c AND a <> b GROUP BY a, b),
two AS (SELECT s.a, s.b, s.n, (s.n + coalesce(t.n, 0)) * 1.0 / (s.n + coalesce(t.n, 0) + 1) AS value FROM tw s LEFT JOIN tw t ON s.a = t.b AND s.b = t.a)"""


@query(f"WITH {LINES}, {EDGES}, {DEPS} SELECT a, b, n, round(value, 6) AS value FROM deps")
def d6_dependencies(spark, d):
    return rounded(heuristics.dependencies(G.discover_dfg(order_lines(spark, d)).edges))


@query(f"WITH {CONV}, {TWO} SELECT a, b, n, round(value, 6) AS value FROM two")
def d7_two_loops(spark, d):
    return rounded(heuristics.two_loops(variants(conversations(spark, d))))


GRAPH = f"""{DEPS}, {TWO}, lev AS (SELECT a, b, value, n, 2 AS level FROM deps WHERE value >= 0.4
UNION ALL SELECT m.a, m.b, m.value, s.n, 1 FROM (SELECT a, b, value FROM two WHERE value >= 0.5 UNION SELECT b, a, value FROM two WHERE value >= 0.5) m JOIN edges s USING (a, b)
UNION ALL SELECT a, b, value, n, 3 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY value DESC, b DESC) AS r FROM deps WHERE a <> b) WHERE r = 1 AND a IN (SELECT activity FROM nodes WHERE n_end = 0)
UNION ALL SELECT a, b, value, n, 3 FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY value DESC, a DESC) AS r FROM deps WHERE a <> b) WHERE r = 1 AND b IN (SELECT activity FROM nodes WHERE n_start = 0)),
graph AS (SELECT a, b, arg_min(value, level) AS value, arg_min(n, level) AS n FROM lev GROUP BY a, b)"""


@query(f"WITH {LINES}, {EDGES}, {GRAPH} SELECT a, b, round(value, 6) AS value, n FROM graph")
def d8_dependency_graph(spark, d):
    return rounded(heuristics.dependency_graph(variants(order_lines(spark, d)), 0.4))


@query(f"""WITH {CONV}, {EDGES}, {GRAPH}, p AS (SELECT e.*, coalesce(lead(pos) OVER w, len) AS nx, coalesce(lag(pos) OVER w, -1) AS pv, len FROM e JOIN seq USING (case_id) WINDOW w AS (PARTITION BY case_id, activity ORDER BY pos)),
o AS (SELECT p.case_id, p.pos, p.activity, q.activity AS x FROM p JOIN graph g ON g.a = p.activity JOIN p q ON q.case_id = p.case_id AND q.activity = g.b AND q.pos > p.pos AND q.pos < p.nx AND g.b <> p.activity
  UNION SELECT p.case_id, p.pos, p.activity, p.activity FROM p JOIN graph g ON g.a = p.activity AND g.b = p.activity WHERE nx = pos + 1 UNION SELECT case_id, pos, activity, '■ end' FROM p WHERE pos = len - 1),
i AS (SELECT p.case_id, p.pos, p.activity, q.activity AS x FROM p JOIN graph g ON g.b = p.activity JOIN p q ON q.case_id = p.case_id AND q.activity = g.a AND q.pos < p.pos AND q.pos > p.pv AND g.a <> p.activity
  UNION SELECT p.case_id, p.pos, p.activity, p.activity FROM p JOIN graph g ON g.a = p.activity AND g.b = p.activity WHERE pv = pos - 1 UNION SELECT case_id, pos, activity, '▶ start' FROM p WHERE pos = 0),
r AS (SELECT 'out' AS side, activity, string_agg(x, ',' ORDER BY x) AS binding FROM o GROUP BY case_id, pos, activity UNION ALL SELECT 'in', activity, string_agg(x, ',' ORDER BY x) FROM i GROUP BY case_id, pos, activity
  UNION ALL SELECT 'out', '▶ start', activity FROM p WHERE pos = 0 UNION ALL SELECT 'in', '■ end', activity FROM p WHERE pos = len - 1)
SELECT side, activity, binding, count(*) AS n FROM r GROUP BY ALL""")
def d9_bindings(spark, d):
    table = cut(variants(conversations(spark, d)), "variants")
    return heuristics.bindings(table, heuristics.dependency_graph(table, 0.4)).select("side", "activity", text("binding").alias("binding"), "n")


@query()
def d10_heuristics_net(spark, d):
    table = cut(variants(conversations(spark, d)), "variants")
    return heuristics.heuristics_net(heuristics.bindings(table, heuristics.dependency_graph(table, 0.5))).tables(spark)[2]


@query(f"WITH {USERDAY}, {EDGES}, w AS (SELECT a, max(n) AS most FROM (SELECT a, n FROM edges UNION ALL SELECT activity, n_end FROM nodes WHERE n_end > 0) GROUP BY a) SELECT a, b, n FROM edges JOIN w USING (a) WHERE n >= 0.3 * most")
def d13_filter_edges(spark, d):
    g = G.discover_dfg(user_days(spark, d))
    return inductive.filter_edges(g.nodes, g.edges, 0.3)


@query()
def d16_inductive_miner(spark, d):
    """Covers the base cases, cuts, splits and fall-throughs as well."""
    return inductive.inductive_miner(variants(conversations(spark, d)), 0.2)[0].table(spark)


@query()
def d11_d15_inductive_steps(spark, d):
    steps = inductive.inductive_miner(variants(user_days(spark, d)), 0.2)[1]
    return steps.select("position", "kind", "operator", F.array_join(F.transform("groups", lambda g: F.array_join(g, ",")), " | ").alias("groups"), "detail")


STATES = """w AS (SELECT case_id, pos, activity, '{' || array_to_string(list_sort(list_distinct(list(activity) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING))), ',') || '}' AS src,
'{' || array_to_string(list_sort(list_distinct(list(activity) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))), ',') || '}' AS dst FROM e),
ts AS (SELECT coalesce(src, '{}') AS src, activity AS event, dst, count(*) AS n FROM w GROUP BY ALL)"""


def _system(spark, d):
    return transitions.transition_system(variants(user_days(spark, d)), "prefix", "set", 2)


@query(f"WITH {USERDAY}, {STATES} SELECT src, event, dst, n FROM ts")
def d18_transition_system(spark, d):
    return _system(spark, d)[0]


@query(f"WITH RECURSIVE {USERDAY}, {STATES}, r AS (SELECT '{{}}' AS state UNION SELECT dst FROM ts JOIN r ON src = state) SELECT state FROM r")
def d19_reachable(spark, d):
    return transitions.reachable(*_system(spark, d))


@query(f"WITH {USERDAY}, {STATES}, k AS (SELECT event, CASE WHEN src LIKE '%view%' AND dst NOT LIKE '%view%' THEN 'exit' WHEN src NOT LIKE '%view%' AND dst LIKE '%view%' THEN 'enter' ELSE 'no cross' END AS kind FROM ts) SELECT event, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM k GROUP BY event")
def d20_event_crossings(spark, d):
    edges, states = _system(spark, d)
    return transitions.event_crossings(edges, states.filter("state like '%view%'")).select("event", text("kinds").alias("kinds"))


@query(f"""WITH {CONV}, p AS (SELECT DISTINCT (string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY pos)) AS text FROM e), x AS (SELECT text, unnest(string_split(text, ',')) AS activity FROM p)
SELECT text, activity, count(*) AS count FROM x GROUP BY ALL""")
def d21_language_matrix(spark, d):
    return transitions.language_matrix(variants(conversations(spark, d)))


def _mined(spark, d):
    """A log and the net that the miner finds for its first half."""
    log = user_days(spark, d)
    tree, _ = inductive.inductive_miner(variants(half_month(log, False)), 0.2)
    return variants(log), tree.net()


def _conversation_net():
    """A fixed model of a conversation: the user speaks and the assistant answers, as often as they like."""
    net = nets.Net()
    for p, a, b in (("start", 1, 0), ("asked", 0, 0), ("answered", 0, 1)):
        net.place(p, a, b)
    net.transition("ask", "user", ["start"], ["asked"])
    net.transition("answer", "assistant", ["asked"], ["answered"])
    net.transition("again", None, ["answered"], ["start"])
    return net


#: Replay of each variant on the fixed conversation net, event by event: tokens in its three places (s, q, a) and the counts so far.
REPLAY = f"""{CONV}, st(variant, n, acts, k, s, q, a, missing, produced, consumed, ask, answer, again, f_ask, f_answer, unknown) AS (
SELECT variant, n, string_split(variant, ','), 0::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 1::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM var
UNION ALL SELECT variant, n, acts, k + 1, s - (u AND s > 0)::BIGINT, q + u::BIGINT - (w AND q > 0)::BIGINT, a - (u AND s = 0 AND a > 0)::BIGINT + w::BIGINT,
missing + (u AND s = 0 AND a = 0)::BIGINT + (w AND q = 0)::BIGINT, produced + (u OR w)::BIGINT + (u AND s = 0 AND a > 0)::BIGINT, consumed + (u OR w)::BIGINT + (u AND s = 0 AND a > 0)::BIGINT,
ask + u::BIGINT, answer + w::BIGINT, again + (u AND s = 0 AND a > 0)::BIGINT, f_ask + (u AND s = 0 AND a = 0)::BIGINT, f_answer + (w AND q = 0)::BIGINT, unknown + (NOT u AND NOT w)::BIGINT
FROM (SELECT *, acts[k + 1] = 'user' AS u, acts[k + 1] = 'assistant' AS w FROM st WHERE k < len(acts))),
rp AS (SELECT variant, n, produced, consumed + 1 AS consumed, missing + (a = 0)::BIGINT AS missing, s + q + greatest(a - 1, 0) AS remaining, ask, answer, again, f_ask, f_answer, unknown FROM st WHERE k = len(acts)),
fi AS (SELECT 'ask' AS transition, sum(n * ask) AS fired, sum(n * f_ask) AS forced FROM rp UNION ALL SELECT 'answer', sum(n * answer), sum(n * f_answer) FROM rp UNION ALL SELECT 'again', sum(n * again), 0 FROM rp)"""
#: Least deviations of each variant from the net's runs, event by event, for the states before the first question, asked and answered.
ALIGN = f"""{CONV}, al(variant, n, acts, k, cs, cq, ca) AS (SELECT variant, n, string_split(variant, ','), 0::BIGINT, 0::BIGINT, 1::BIGINT, 2::BIGINT FROM var
UNION ALL SELECT variant, n, acts, k + 1, least(xs, xa, xq + 1, xs + 2), least(xq, xs + 1, xa + 1), least(xa, xq + 1, xs + 2)
FROM (SELECT variant, n, acts, k, cs + 1 AS xs, CASE WHEN acts[k + 1] = 'user' THEN least(cq + 1, cs, ca) ELSE cq + 1 END AS xq, CASE WHEN acts[k + 1] = 'assistant' THEN least(ca + 1, cq) ELSE ca + 1 END AS xa FROM al WHERE k < len(acts))),
ac AS (SELECT variant, n, ca AS cost, len(acts) + 2 AS worst, 1 - ca / (len(acts) + 2) AS fitness FROM al WHERE k = len(acts)),
af AS (SELECT sum(fitness * n) / sum(n) AS average_fitness, 1 - sum(cost * n) / sum(worst * n) AS log_fitness, sum(n) AS cases, coalesce(sum(n) FILTER (WHERE cost = 0), 0) AS fitting FROM ac)"""
#: Of the prefixes that the net can follow (they alternate), how many cases go on otherwise only.
PRECISE = """w AS (SELECT case_id, pos, activity, CASE WHEN pos % 2 = 0 THEN 'user' ELSE 'assistant' END AS may FROM e),
ok AS (SELECT *, coalesce(bool_and(activity = may) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS follows FROM w),
pe AS (SELECT 1 - sum(CASE WHEN seen THEN 0 ELSE n END) / sum(n) AS precision FROM (SELECT pos, count(*) AS n, bool_or(activity = may) AS seen FROM ok WHERE follows GROUP BY pos))"""
FIT = "0.5 * (1 - sum(n * missing) / sum(n * consumed)) + 0.5 * (1 - sum(n * remaining) / sum(n * produced))"
GENERAL = "(SELECT 1 - avg(CASE WHEN fired > 0 THEN 1 / sqrt(fired) ELSE 1.0 END) FROM fi)"


@query()
def c1_token_replay(spark, d):
    return conformance.token_replay(*_mined(spark, d)).select(text("variant").alias("variant"), "n", "produced", "consumed", "missing", "remaining", "fits")


@query(f"WITH RECURSIVE {REPLAY} SELECT variant, n, produced, consumed, missing, remaining, missing = 0 AND remaining = 0 AND unknown = 0 AS fits FROM rp")
def c1_replay_of_conversations(spark, d):
    return conformance.token_replay(variants(conversations(spark, d)), _conversation_net()).select(text("variant").alias("variant"), "n", "produced", "consumed", "missing", "remaining", "fits")


@query()
def c2_replay_fitness(spark, d):
    return rounded(conformance.replay_fitness(conformance.token_replay(*_mined(spark, d))))


@query(f"WITH RECURSIVE {REPLAY} SELECT round({FIT}, 6) AS fitness, sum(n)::BIGINT AS cases, coalesce(sum(n) FILTER (WHERE missing = 0 AND remaining = 0 AND unknown = 0), 0)::BIGINT AS fitting FROM rp")
def c2_fitness_of_conversations(spark, d):
    return rounded(conformance.replay_fitness(conformance.token_replay(variants(conversations(spark, d)), _conversation_net())))


@query(f"WITH RECURSIVE {REPLAY} SELECT transition, fired::BIGINT AS fired, forced::BIGINT AS forced FROM fi WHERE fired > 0")
def c3_replay_totals(spark, d):
    return conformance.replay_totals(conformance.token_replay(variants(conversations(spark, d)), _conversation_net()))[1]


@query(f"WITH RECURSIVE {ALIGN} SELECT variant, n, cost, round(fitness, 6) AS fitness FROM ac")
def c4_align(spark, d):
    return rounded(conformance.align(variants(conversations(spark, d)), _conversation_net()).select(text("variant").alias("variant"), "n", "cost", "fitness"))


@query(f"WITH RECURSIVE {ALIGN} SELECT round(average_fitness, 6) AS average_fitness, round(log_fitness, 6) AS log_fitness, cases::BIGINT AS cases, fitting::BIGINT AS fitting FROM af")
def c5_alignment_fitness(spark, d):
    return rounded(conformance.alignment_fitness(conformance.align(variants(conversations(spark, d)), _conversation_net()), 2))


@query(f"WITH {CONV}, {PRECISE} SELECT round(precision, 6) AS precision FROM pe")
def c6_precision(spark, d):
    return rounded(conformance.precision(variants(conversations(spark, d)), _conversation_net()))


@query(f"WITH RECURSIVE {REPLAY} SELECT round({GENERAL}, 6) AS generalisation")
def c7_generalisation(spark, d):
    net = _conversation_net()
    return rounded(conformance.generalisation(conformance.token_replay(variants(conversations(spark, d)), net), net))


@query(f"WITH RECURSIVE {REPLAY}, {ALIGN.removeprefix(CONV)[2:]}, {PRECISE} SELECT round((SELECT average_fitness FROM af), 6) AS fitness, round((SELECT precision FROM pe), 6) AS precision, round({GENERAL}, 6) AS generalisation, 1.0::DOUBLE AS simplicity")
def c9_check_fit(spark, d):
    return rounded(check_fit(variants(conversations(spark, d)), _conversation_net(), alignments=True))


@query(f"""WITH {USERDAY}, a AS (SELECT DISTINCT variant FROM seq WHERE right(case_id, 2)::INT <= 15), b AS (SELECT DISTINCT variant FROM seq WHERE right(case_id, 2)::INT > 15)
SELECT (SELECT count(*) FROM a) AS left_traces, (SELECT count(*) FROM b) AS right_traces, count(*) AS common, round(count(*) * 1.0 / (SELECT count(*) FROM a), 6) AS recall, round(count(*) * 1.0 / (SELECT count(*) FROM b), 6) AS precision FROM a JOIN b USING (variant)""")
def c10_trace_overlap(spark, d):
    log = user_days(spark, d)
    return rounded(conformance.trace_overlap(variants(half_month(log, False)), variants(half_month(log, True))))


@query(f"""WITH {USERDAY}, a AS (SELECT DISTINCT string_split(variant, ',') AS v FROM seq WHERE right(case_id, 2)::INT <= 15), b AS (SELECT DISTINCT string_split(variant, ',') AS v FROM seq WHERE right(case_id, 2)::INT > 15)
SELECT 'left' AS side, array_to_string(v, ',') AS variant FROM (SELECT v FROM a WHERE v NOT IN (FROM b) ORDER BY len(v), v LIMIT 3) UNION ALL SELECT 'right', array_to_string(v, ',') FROM (SELECT v FROM b WHERE v NOT IN (FROM a) ORDER BY len(v), v LIMIT 3)""")
def c10_trace_differences(spark, d):
    log = user_days(spark, d)
    out = conformance.trace_differences(variants(half_month(log, False)), variants(half_month(log, True)))
    return out.select("side", text("variant").alias("variant"))


PREF = """pr AS (SELECT case_id, pos + 1 AS prefix_length, string_agg(activity, ',') OVER (PARTITION BY case_id ORDER BY pos) AS prefix, coalesce(lead(activity) OVER (PARTITION BY case_id ORDER BY pos), '⟂') AS next_activity,
last_value(activity) OVER (PARTITION BY case_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS outcome,
(epoch_us(max(ts) OVER (PARTITION BY case_id)) - epoch_us(ts)) / 3.6e9 AS remaining_hours, min(ts) OVER (PARTITION BY case_id) AS case_start FROM e)"""


@query(f"WITH {USERDAY}, {PREF} SELECT case_id, CAST(prefix_length AS INT) AS prefix_length, prefix FROM pr WHERE prefix_length <= 5")
def p1_prefixes(spark, d):
    return prediction.prefix_rows(user_days(spark, d), 1, 5).select("case_id", "prefix_length", text("prefix").alias("prefix"))


@query(f"WITH {USERDAY}, {PREF} SELECT case_id, CAST(prefix_length AS INT) AS prefix_length, next_activity, outcome, round(remaining_hours, 6) AS remaining_hours FROM pr WHERE prefix_length <= 20")
def p2_labels(spark, d):
    return rounded(prediction.prefix_rows(user_days(spark, d)).select("case_id", "prefix_length", "next_activity", "outcome", "remaining_hours"))


@query(f"WITH {USERDAY}, {PREF} SELECT case_id, CAST(prefix_length AS INT) AS length, CAST(len(list_filter(string_split(prefix, ','), lambda x: x = 'view')) AS INT) AS count_view, CAST(prefix = 'view' OR prefix LIKE '%,view' AS INT) AS last_view FROM pr WHERE prefix_length <= 20")
def p3_frequency_features(spark, d):
    rows = prediction.frequency_features(prediction.prefix_rows(user_days(spark, d)), ["view", "click", "purchase"])
    return rows.select("case_id", "length", F.col("count view").alias("count_view"), F.col("last is view").alias("last_view"))


@query(f"""WITH {USERDAY}, {PREF}, k AS (SELECT case_id, prefix_length, list_transform(string_split(prefix, ',')[-3:], lambda x: CASE x WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END) AS f FROM pr WHERE prefix_length <= 20)
SELECT case_id, CAST(prefix_length AS INT) AS prefix_length, array_to_string(list_transform(range(3 - len(f)), lambda x: -1) || f, ',') AS features FROM k""")
def p4_index_features(spark, d):
    rows = prediction.index_features(prediction.prefix_rows(user_days(spark, d)), ["view", "click", "purchase"], 3)
    return rows.select("case_id", "prefix_length", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"))


@query(f"""WITH {USERDAY}, {PREF}, k AS (SELECT case_id, prefix_length, string_split(prefix, ',')[-2:] AS f FROM pr WHERE prefix_length <= 20),
w AS (SELECT case_id, prefix_length, list_transform(range(2 - len(f)), lambda x: NULL::VARCHAR) || f AS f FROM k)
SELECT case_id, CAST(prefix_length AS INT) AS prefix_length, array_to_string(list_transform(f, lambda x: coalesce((x = 'view')::INT, 0) || ',' || coalesce((x = 'click')::INT, 0) || ',' || coalesce((x = 'purchase')::INT, 0)), ',') AS features FROM w""")
def p4_one_hot_features(spark, d):
    rows = prediction.one_hot_features(prediction.prefix_rows(user_days(spark, d)), ["view", "click", "purchase"], 2)
    return rows.select("case_id", "prefix_length", F.array_join(F.transform("features", lambda x: x.cast("string")), ",").alias("features"))


@query(f"""WITH {USERDAY}, {PREF}, c AS (SELECT case_id, row_number() OVER (ORDER BY min(case_start), case_id) AS r, count(*) OVER () AS m FROM pr WHERE prefix_length <= 20 GROUP BY case_id)
SELECT case_id FROM c WHERE r <= greatest(round_even(m * 0.7, 0), 1)""")
def p5_split_by_time(spark, d):
    return prediction.split_by_time(prediction.prefix_rows(user_days(spark, d)))[0].select("case_id").distinct()


@query(f"""WITH {USERDAY}, {PREF}, k AS (SELECT *, string_split(prefix, ',')[-1] AS last FROM pr), m AS (SELECT last, next_activity, count(*) AS n FROM k GROUP BY ALL)
SELECT last, arg_min(next_activity, (-n, next_activity)) AS predicted FROM m GROUP BY last""")
def p6_frequency_model(spark, d):
    rows = prediction.next_steps(user_days(spark, d))
    return prediction.fit_frequency(rows, "last", "next_activity")[0]


@query()
def p7_forest(spark, d):
    rows = prediction.frequency_features(prediction.prefix_rows(user_days(spark, d)), ["view", "click", "purchase"])
    names = ["count view", "count click", "count purchase", "length", "last is view", "last is click", "last is purchase"]
    rows = cut(rows.select("case_id", "case_start", "prefix_length", "next_activity", *names), "features")  # windows over all events run once
    train, test = prediction.split_by_time(rows)
    model = prediction.forest(train, names, "next_activity", trees=5)
    return rounded(prediction.evaluate(model.transform(test), "next_activity"))


@query(f"""WITH {USERDAY}, {PREF}, k AS (SELECT *, string_split(prefix, ',')[-1] AS last FROM pr WHERE prefix_length <= 20), m AS (SELECT last, next_activity, count(*) AS n FROM k GROUP BY ALL),
f AS (SELECT last, arg_min(next_activity, (-n, next_activity)) AS predicted FROM m GROUP BY last)
SELECT CAST(prefix_length AS INT) AS prefix_length, count(*) AS rows, round(avg((predicted = next_activity)::INT), 6) AS score FROM k JOIN f USING (last) GROUP BY GROUPING SETS ((prefix_length), ())""")
def p8_evaluate(spark, d):
    rows = prediction.prefix_rows(user_days(spark, d)).withColumn("last", F.try_element_at("prefix", F.lit(-1)))
    model = prediction.fit_frequency(rows, "last", "next_activity")
    return rounded(prediction.evaluate(prediction.predict_frequency(rows, model, "last"), "next_activity"))


def _unit(key: str, seed: int, k: int) -> str:
    """The SQL of a number between 0 and 1 that follows from a key."""
    return f"((('0x' || substr(sha256(concat_ws('|', {key}, '{seed}', '{k}')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)"


POISSON = "len(list_filter(list_transform(range(0, 40), lambda i: list_sum(list_transform(range(0, i + 1), lambda j: exp(-n) * pow(n, j) / gamma(j + 1)))), lambda t: t < {u}))"


@query(f"""WITH RECURSIVE {REPLAY}, d AS (SELECT *, unnest(range(1, 201)) AS sample FROM rp),
u AS (SELECT *, {_unit("variant, sample", 3, 1)} AS u1, {_unit("variant, sample", 3, 2)} AS u2, {_unit("variant, sample", 3, 3)} AS u3 FROM d),
w AS (SELECT *, CASE WHEN n >= 10 THEN greatest(round(n + sqrt(-2 * ln(u1)) * cos(2 * pi() * u2) * sqrt(n)), 0) ELSE {POISSON.format(u="u3")} END AS w FROM u),
f AS (SELECT sample, 0.5 * (CASE WHEN sum(w * consumed) = 0 THEN 1 ELSE 1 - sum(w * missing) / sum(w * consumed) END) + 0.5 * (CASE WHEN sum(w * produced) = 0 THEN 1 ELSE 1 - sum(w * remaining) / sum(w * produced) END) AS f FROM w GROUP BY sample)
SELECT round(avg(f), 6) AS mean, round(quantile_cont(f, 0.025), 6) AS low, round(quantile_cont(f, 0.975), 6) AS high FROM f""")
def e1_bootstrap(spark, d):
    replayed = conformance.token_replay(variants(conversations(spark, d)), _conversation_net())
    return rounded(experiments.bootstrap_fitness(replayed, 200, 3))


@query()
def e1_resampled(spark, d):
    replayed = conformance.token_replay(variants(conversations(spark, d)), _conversation_net())
    return rounded(experiments.resampled_fitness(replayed, 200, 3))


@query("""WITH x AS (SELECT hour(ts) >= 8 AS late, hour(ts) AS h, sum(value) AS v FROM events WHERE hour(ts) < 16 GROUP BY ALL), r AS (SELECT late, row_number() OVER (ORDER BY v) AS k FROM x),
o AS (SELECT sum(k) FILTER (WHERE NOT late) - 36 AS u FROM r), a AS (SELECT list_sum(list_transform(range(16), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) - 36 AS u FROM range(65536) t(m) WHERE bit_count(m) = 8),
p AS (SELECT o.u, least(1.0::DOUBLE, 2.0::DOUBLE * count(*) FILTER (WHERE a.u >= greatest(o.u, 64 - o.u)) / count(*)) AS p_u FROM o, a GROUP BY o.u)
SELECT u::DOUBLE AS u, round(p_u, 9) AS p_u, true AS exact, p_u < 0.05 AS differ, CASE WHEN p_u >= 0.05 THEN 'no difference' WHEN (SELECT avg(v) FILTER (WHERE NOT late) > avg(v) FILTER (WHERE late) FROM x) THEN 'early is higher' ELSE 'late is higher' END AS verdict FROM p""")
def e2_exact(spark, d):
    """The values of eight hours of the night against those of eight hours of the day."""
    hour = F.hour("ts")
    rows = table(spark, d, "events").filter(hour < 16).groupBy(F.when(hour < 8, "early").otherwise("late").alias("part"), hour.alias("h")).agg(F.sum("value").alias("v"))
    return rounded(experiments.comparison(rows, "part", "v").select("u", "p_u", "exact", "differ", "verdict"), 9)


@query(f"""WITH {USERDAY}, x AS (SELECT right(case_id, 2)::INT > 15 AS late, len AS v FROM seq), r AS (SELECT late, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM x)
SELECT round(sum(k) FILTER (WHERE NOT late) - count(*) FILTER (WHERE NOT late) * (count(*) FILTER (WHERE NOT late) + 1) / 2.0, 4) AS u, count(*) FILTER (WHERE NOT late) AS n1, count(*) FILTER (WHERE late) AS n2 FROM r""")
def e2_mann_whitney(spark, d):
    rows = user_days(spark, d).events.groupBy("case_id").agg(F.count("*").alias("v")).withColumn("late", F.substring("case_id", -2, 2).cast("int") > 15)
    return rounded(experiments.mann_whitney(rows, "late", "v").select("u", "n1", "n2"), 4)


@query(f"""WITH {USERDAY}, x AS (SELECT right(case_id, 2)::INT > 15 AS late, len AS v FROM seq), m AS (SELECT late, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM x GROUP BY late)
SELECT round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS t, round(a.mean, 6) AS mean_a, round(b.mean, 6) AS mean_b FROM m a, m b WHERE NOT a.late AND b.late""")
def e2_welch(spark, d):
    rows = user_days(spark, d).events.groupBy("case_id").agg(F.count("*").alias("v")).withColumn("late", F.substring("case_id", -2, 2).cast("int") > 15)
    return rounded(experiments.welch(rows, "late", "v").select("t", "mean_a", "mean_b"))


@query(f"WITH {LINES}, {EDGES}, {DEPS} SELECT t AS threshold, count(*) FILTER (WHERE value >= t) AS edges FROM deps, (VALUES (0.0::DOUBLE), (0.2), (0.4)) v(t) GROUP BY t")
def e3_sweep(spark, d):
    grid = experiments.parameter_grid(spark, threshold=experiments.parse_values("0..0.4 step 0.2"))
    return experiments.dependency_sweep(heuristics.dependencies(G.discover_dfg(order_lines(spark, d)).edges), grid)


@query(f"""WITH {USERDAY}, n AS (SELECT case_id, len, {_unit("case_id", 5, 1)} < 0.3 AND len > 1 AS damaged, {_unit("case_id", 5, 2)} < 0.5 AS lost FROM seq)
SELECT count(*) AS cases, count(*) FILTER (WHERE damaged) AS damaged, (sum(len) - count(*) FILTER (WHERE damaged AND lost))::BIGINT AS events FROM n""")
def e4_noise(spark, d):
    log = experiments.add_noise(user_days(spark, d), 0.3, 5)
    return log.cases.agg(F.count("*").alias("cases"), F.count_if("damaged").alias("damaged")).crossJoin(log.events.agg(F.count("*").alias("events")))


@query(f"""WITH {USERDAY}, c AS (SELECT case_id, case_id || '=' || sha256(string_agg(activity || '|' || epoch_us(ts), chr(10) ORDER BY pos)) AS h FROM e GROUP BY case_id),
b AS (SELECT substr(sha256(case_id), 1, 3) AS bucket, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM c GROUP BY 1)
SELECT sha256(string_agg(h, chr(10) ORDER BY bucket)) AS fingerprint FROM b""")
def e5_fingerprint(spark, d):
    return experiments.log_fingerprint(user_days(spark, d))


@query(f"""WITH {USERDAY}, a AS (SELECT activity AS name, count(*) AS value FROM e WHERE right(case_id, 2)::INT <= 15 GROUP BY 1), b AS (SELECT activity AS name, count(*) AS value FROM e WHERE right(case_id, 2)::INT > 15 GROUP BY 1)
SELECT name, a.value AS a, b.value AS b FROM a FULL JOIN b USING (name) WHERE a.value IS DISTINCT FROM b.value""")
def e6_changed(spark, d):
    log = user_days(spark, d)
    count = lambda x: x.events.groupBy(F.col("activity").alias("name")).agg(F.count("*").alias("value"))
    return experiments.changed(count(half_month(log, False)), count(half_month(log, True)))
