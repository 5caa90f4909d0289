"""Queries on projections, filters, statistics, windows, directly-follows graphs and object-centric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..log import to_table
from ..operators import dfg as G
from ..operators import edits, filters, objects, statistics, timeline
from ..operators.variants import expand, has_lifecycle_pairs, notation, sequences, variant_counts, variants
from .base import CONV, EDGES, LINES, OC, USER, USERDAY, conversations, half_month, order_lines, order_objects, query, rounded, table, text, user_days, users

BIG = "CAST({} AS BIGINT)".format


@query(f"WITH {USERDAY} SELECT case_id, CAST(pos AS INT) AS pos, activity, event_id FROM e")
def s1_log_table(spark, d):
    return user_days(spark, d).events.select("case_id", "pos", "activity", "event_id")


@query(f"""WITH {USERDAY} SELECT case_id, CAST(pos AS INT) AS pos, activity, epoch_us(ts) AS ts_us, CAST(user_id AS VARCHAR) AS resource FROM e""")
def s17_flat_table(spark, d):
    return to_table(user_days(spark, d)).select("case_id", "pos", "activity", F.unix_micros("ts").alias("ts_us"), "resource")


@query("""SELECT event_id, epoch_us(ts) AS ts_us, 90 AS offset_min FROM events""")
def s4_parse_timestamp(spark, d):
    e = table(spark, d, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    slash = F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSSSSS")
    written = F.when(F.col("event_id") % 2 == 0, iso).otherwise(slash)
    return e.select("event_id", F.unix_micros(X.parse_timestamp(written)).alias("ts_us"), X.utc_offset_minutes(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))).alias("offset_min"))


@query("""SELECT event_id, user_id AS whole, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN round(value, 6) END AS real_value, event_type AS other FROM events""")
def s5_typed_text(spark, d):
    e = table(spark, d, "events")
    a, b, c = X.typed_text(F.col("user_id").cast("string")), X.typed_text(F.concat(F.col("value").cast("string"), F.lit(""))), X.typed_text(F.col("event_type"))
    return e.select("event_id", a["whole"].alias("whole"), F.when(F.col("event_id") % 3 == 1, F.round(F.coalesce(b["real"], b["whole"].cast("double")), 6)).alias("real_value"), c["other"].alias("other"))


@query("""SELECT event_id, epoch_us(ts) // 1000000 AS s FROM events""")
def s11_object_time(spark, d):
    e = table(spark, d, "events")
    written = F.when(F.col("event_id") % 2 == 0, F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return e.select("event_id", F.unix_seconds(X.epoch_or_text_time(written)).alias("s"))


@query(f"""WITH {CONV} SELECT '<' || variant || '>' || CASE WHEN n > 1 THEN '^' || n ELSE '' END AS text FROM var""")
def s16_notation(spark, d):
    return notation(variants(conversations(spark, d))).select("text")


@query("""SELECT event_type || '+' || coalesce(CAST(user_id AS VARCHAR), '') AS label, count(*) AS n FROM events GROUP BY 1""")
def l1_classifier(spark, d):
    from ..log import Classifier

    c = Classifier("name + resource", keys=("activity", "resource"))
    return user_days(spark, d).events.filter(c.accepts()).groupBy(c.label().alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT bool_or(lower(event_type) = 'start') AND bool_or(lower(event_type) = 'complete') AS pairs FROM events""")
def l2_lifecycle_pairs(spark, d):
    return spark.range(1).select(F.lit(has_lifecycle_pairs(user_days(spark, d))).alias("pairs"))


@query(f"WITH {USERDAY} SELECT case_id, variant FROM seq")
def l3_sequences(spark, d):
    return sequences(user_days(spark, d)).select("case_id", text("variant").alias("variant"))


@query(f"WITH {LINES} SELECT variant, n FROM var")
def l4_variants(spark, d):
    return variants(order_lines(spark, d)).select(text("variant").alias("variant"), "n")


@query(f"""WITH RECURSIVE {USER}, w AS (SELECT max(pos) AS most FROM e), pw(i, p0, p1) AS (SELECT 0, 1::BIGINT, 1::BIGINT UNION ALL SELECT i + 1, p0 * 1000003 % 2147483647, p1 * 998244353 % 2147483629 FROM pw, w WHERE i < most),
h AS (SELECT activity, 1 + ('0x' || substr(sha256(activity), 1, 7))::BIGINT AS c0, 1 + ('0x' || substr(sha256(activity), 8, 7))::BIGINT AS c1 FROM (SELECT DISTINCT activity FROM e)),
d AS (SELECT case_id, count(*) AS length, sum(c0 * p0 % 2147483647) % 2147483647 AS s0, sum(c1 * p1 % 2147483629) % 2147483629 AS s1 FROM e JOIN pw ON i = pos JOIN h USING (activity) GROUP BY case_id)
SELECT concat_ws('-', length, s0, s1) AS digest, length, count(*) AS n, min(case_id) AS example FROM d GROUP BY ALL""")
def l4_variant_digests(spark, d):
    return variant_counts(users(spark, d)).select("digest", "length", "n", "example")


@query(f"WITH {CONV} SELECT count(*) AS cases, CAST(sum(len) AS BIGINT) AS events FROM seq")
def l5_expand(spark, d):
    log = expand(variants(conversations(spark, d)))
    return log.cases.agg(F.count("*").alias("cases")).crossJoin(log.events.agg(F.count("*").alias("events")))


@query(f"WITH {USERDAY} SELECT case_id, activity, CAST(pos AS INT) AS pos FROM e WHERE case_id IN (SELECT case_id FROM e WHERE value > 90)")
def l7_keep_cases(spark, d):
    log = user_days(spark, d)
    return log.keep_cases(log.events.filter("value > 90")).events.select("case_id", "activity", "pos")


@query(f"""WITH {USER}, g AS (SELECT *, activity IS DISTINCT FROM lag(activity) OVER (PARTITION BY case_id ORDER BY pos) AS new FROM e),
h AS (SELECT *, sum(new::INT) OVER (PARTITION BY case_id ORDER BY pos) AS run FROM g)
SELECT case_id, CAST(run AS INT) - 1 AS run, min(activity) AS label, CAST(count(*) AS INT) AS n FROM h GROUP BY case_id, run""")
def l8_runs(spark, d):
    rows = sequences(users(spark, d)).select("case_id", F.posexplode(X.runs_of(F.col("variant"))).alias("run", "r"))
    return rows.select("case_id", "run", "r.label", "r.n")


@query("SELECT CASE WHEN event_type = 'click' THEN 'tap' ELSE event_type END AS activity, count(*) AS n FROM events GROUP BY 1")
def l9_rename_activity(spark, d):
    return edits.rename_activity(user_days(spark, d), "click", "tap").events.groupBy("activity").agg(F.count("*").alias("n"))


@query(f"WITH {USERDAY} SELECT case_id, CAST(count(*) FILTER (WHERE activity <> 'click') AS BIGINT) AS events FROM e GROUP BY case_id")
def l10_remove_activity(spark, d):
    log = edits.remove_activity(user_days(spark, d), "click")
    return log.cases.join(log.events.groupBy("case_id").agg(F.count("*").alias("events")), "case_id", "left").fillna(0, ["events"]).select("case_id", "events")


@query(f"""WITH {USERDAY}, s AS (SELECT case_id, CASE WHEN pos = 0 AND len > 1 THEN 1 WHEN pos = 1 THEN 0 ELSE pos END AS pos, activity FROM e JOIN seq USING (case_id))
SELECT case_id, CAST(pos AS INT) AS pos, activity FROM s""")
def l11_swap_events(spark, d):
    log = user_days(spark, d)
    return edits.swap_events(log, log.cases.select("case_id", F.lit(0).alias("pos"))).events.select("case_id", "pos", "activity")


@query("SELECT false AS plain")
def l12_is_plain(spark, d):
    return edits.is_plain(user_days(spark, d))


def _cases(log):
    return log.events.groupBy("case_id").agg(F.count("*").alias("events"))


SPAN = "SELECT case_id, len AS events FROM seq WHERE {}"


@query(f"WITH {USERDAY}, m AS (SELECT min(ts) AS t0 FROM events) " + "SELECT case_id, len AS events FROM seq, m WHERE low >= date_trunc('day', t0) + INTERVAL 5 DAY AND high < date_trunc('day', t0) + INTERVAL 13 DAY")
def f1_time_frame(spark, d):
    t0 = table(spark, d, "events").agg(F.date_format(F.date_trunc("day", F.min("ts")), "yyyy-MM-dd").alias("t")).first()["t"]
    from datetime import date, timedelta

    day = date.fromisoformat(t0)
    return _cases(filters.time_frame(user_days(spark, d), str(day + timedelta(5)), str(day + timedelta(12))))


@query(f"WITH {USERDAY} " + SPAN.format("variant LIKE 'view%' OR variant LIKE 'click%'"))
def f2_start_activities(spark, d):
    return _cases(filters.start_activities(user_days(spark, d), ["view", "click"]))


@query(f"WITH {USERDAY} " + SPAN.format("variant LIKE '%purchase'"))
def f3_end_activities(spark, d):
    return _cases(filters.end_activities(user_days(spark, d), ["purchase"]))


@query(f"WITH {USERDAY} SELECT case_id, activity, CAST(row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS INT) AS pos FROM e WHERE activity IN ('view', 'purchase')")
def f4_keep_activities(spark, d):
    return filters.keep_activities(user_days(spark, d), ["view", "purchase"]).events.select("case_id", "activity", "pos")


@query(f"WITH {USERDAY} " + SPAN.format("variant LIKE '%purchase%'"))
def f5_mandatory(spark, d):
    return _cases(filters.mandatory_activities(user_days(spark, d), ["purchase"]))


@query(f"WITH {USERDAY} " + SPAN.format("variant NOT LIKE '%purchase%'"))
def f6_forbidden(spark, d):
    return _cases(filters.forbidden_activities(user_days(spark, d), ["purchase"]))


@query(f"WITH {USERDAY} " + SPAN.format("len BETWEEN 3 AND 5"))
def f7_case_length(spark, d):
    return _cases(filters.case_length(user_days(spark, d), 3, 5))


@query(f"WITH {USERDAY} SELECT variant, n FROM var ORDER BY n DESC, first LIMIT 10")
def f8_top_variants(spark, d):
    return filters.top_variants(variants(user_days(spark, d)), count=10).select(text("variant").alias("variant"), "n")


@query(f"""WITH {USERDAY}, r AS (SELECT variant, n, coalesce(sum(n) OVER (ORDER BY n DESC, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER () AS total FROM var)
SELECT variant, n FROM r WHERE before < 0.8 * total OR before = 0""")
def f9_coverage(spark, d):
    return filters.top_variants(variants(user_days(spark, d)), coverage=80.0).select(text("variant").alias("variant"), "n")


@query(f"""WITH {USERDAY}, k AS (SELECT * FROM seq WHERE variant LIKE 'view%' AND len BETWEEN 2 AND 6),
v AS (SELECT variant, count(*) AS n, min((low, first_id)) AS first FROM k GROUP BY variant ORDER BY n DESC, first LIMIT 5)
SELECT case_id, len AS events FROM k WHERE variant IN (SELECT variant FROM v)""")
def f10_apply_filters(spark, d):
    return _cases(filters.apply_filters(user_days(spark, d), filters.FilterSettings(starts=("view",), least=2, most=6, top=5)))


@query(f"""WITH {USERDAY}, k AS (SELECT * FROM seq WHERE len >= 3)
SELECT (SELECT count(*) FROM seq) AS cases_before, (SELECT count(*) FROM k) AS cases_after, (SELECT CAST(sum(len) AS BIGINT) FROM seq) AS events_before, (SELECT CAST(sum(len) AS BIGINT) FROM k) AS events_after,
round((SELECT count(*) FROM k) * 1.0 / (SELECT count(*) FROM seq), 6) AS share""")
def f11_preview(spark, d):
    log = user_days(spark, d)
    a, b = statistics.summarise(log), statistics.summarise(filters.case_length(log, 3))
    both = a.select(F.col("cases").alias("cases_before"), F.col("events").alias("events_before")).crossJoin(b.select(F.col("cases").alias("cases_after"), F.col("events").alias("events_after")))
    return both.withColumn("share", F.round(F.col("cases_after") / F.col("cases_before"), 6))


@query(f"WITH {USERDAY} " + SPAN.format("lower(case_id) LIKE '%7|%'"))
def f12_search(spark, d):
    return _cases(filters.search_cases(user_days(spark, d), "7|"))


@query(f"""WITH {USERDAY} SELECT (SELECT count(*) FROM seq) AS cases, (SELECT count(*) FROM var) AS variants, count(*) AS events, count(DISTINCT activity) AS activities, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM e""")
def a1_summary(spark, d):
    return statistics.summarise(user_days(spark, d)).select("cases", "variants", "events", "activities", F.unix_micros("first_event").alias("first_us"), F.unix_micros("last_event").alias("last_us"))


@query(f"WITH {USERDAY} SELECT variant, n, row_number() OVER (ORDER BY n DESC, string_split(variant, ',')) AS rank, round(n * 1.0 / sum(n) OVER (), 9) AS share, CAST(len AS INT) AS length FROM var")
def a2_variant_table(spark, d):
    return statistics.variant_table(user_days(spark, d)).select(text("variant").alias("variant"), "n", "rank", F.round("share", 9).alias("share"), "length")


@query(f"WITH {USERDAY}, {EDGES}, c AS (SELECT activity, count(DISTINCT case_id) AS cases FROM e GROUP BY activity) SELECT activity AS label, n AS occurrences, cases, n_start AS as_start, n_end AS as_end FROM nodes JOIN c USING (activity)")
def a3_activities(spark, d):
    return statistics.activity_statistics(user_days(spark, d))


@query(f"WITH {USERDAY}, h AS (SELECT len, count(*) AS cases FROM seq GROUP BY len), r AS (SELECT unnest(range((SELECT min(len) FROM h), (SELECT max(len) FROM h) + 1)) AS len) SELECT CAST(r.len AS INT) AS length, coalesce(cases, 0) AS cases FROM r LEFT JOIN h USING (len)")
def a4_events_per_case(spark, d):
    return statistics.events_per_case(user_days(spark, d), fill=True)


DUR = "(epoch_us(high) - epoch_us(low)) / 1e6"


@query(f"WITH {USERDAY} SELECT count(*) AS cases, round(avg({DUR}), 5) AS mean, round(median({DUR}), 5) AS median, round(min({DUR}), 5) AS shortest, round(max({DUR}), 5) AS longest FROM seq")
def a5_durations(spark, d):
    return rounded(statistics.duration_statistics(user_days(spark, d)), 5)


@query(f"""WITH {USERDAY}, r AS (SELECT variant, row_number() OVER (ORDER BY n DESC, string_split(variant, ',')) AS k FROM var)
SELECT case_id, len AS events, epoch_us(low) AS start_us, round({DUR}, 6) AS duration, k AS variant_number FROM seq JOIN r USING (variant)""")
def a6_case_table(spark, d):
    t = statistics.case_table(user_days(spark, d))
    return t.select("case_id", "events", F.unix_micros("start").alias("start_us"), F.round("duration", 6).alias("duration"), "variant_number")


FIGURES = f"""s AS (SELECT count(*) AS cases, max(len) AS longest, sum(len) AS events, avg(len) AS mean_len, avg({DUR}) AS md, median({DUR}) AS med, min({DUR}) AS mi, max({DUR}) AS ma, epoch_us(min(low)) / 1e6 AS f, epoch_us(max(high)) / 1e6 AS l FROM {{0}}),
v AS (SELECT count(*) AS variants, max(n) AS top FROM (SELECT variant, count(*) AS n FROM {{0}} GROUP BY variant)),
a AS (SELECT count(DISTINCT activity) AS activities FROM e WHERE case_id IN (SELECT case_id FROM {{0}})),
f AS (UNPIVOT (SELECT CAST(cases AS DOUBLE) AS cases, CAST(variants AS DOUBLE) AS variants, 100.0 * top / cases AS "top variant %", mean_len AS "mean length", CAST(longest AS DOUBLE) AS "longest case", CAST(events AS DOUBLE) AS events, CAST(activities AS DOUBLE) AS activities, f AS "first event", l AS "last event", l - f AS span, md AS "mean duration", med AS "median duration", mi AS "shortest duration", ma AS "longest duration" FROM s, v, a) ON COLUMNS(*) INTO NAME figure VALUE value)"""


@query(f"WITH {USERDAY}, {FIGURES.format('seq')} SELECT figure, round(value, 4) AS value FROM f")
def a7_key_figures(spark, d):
    return rounded(statistics.key_figures(user_days(spark, d)), 4)


@query(f"""WITH {USERDAY}, x AS (SELECT activity, count(*) FILTER (WHERE right(case_id, 2)::INT <= 15) AS a, count(*) FILTER (WHERE right(case_id, 2)::INT > 15) AS b FROM e GROUP BY activity)
SELECT activity AS figure, CASE WHEN a = b THEN '=' WHEN a = 0 THEN 'new' ELSE printf('%+.0f%%', (b - a) * 100.0 / a) END AS difference FROM x""")
def a8_relative_difference(spark, d):
    log = user_days(spark, d)
    count = lambda x: x.events.groupBy(F.col("activity").alias("figure")).agg(F.count("*").cast("double").alias("value"))
    return statistics.compare_figures(count(half_month(log, False)), count(half_month(log, True))).select("figure", "difference")


@query(f"""WITH {USERDAY}, h AS (SELECT *, right(case_id, 2)::INT > 15 AS late FROM e), t AS (SELECT late, count(DISTINCT case_id) AS total FROM h GROUP BY late),
x AS (SELECT activity, late, count(DISTINCT case_id) * 1.0 / any_value(total) AS share, count(*) AS events FROM h JOIN t USING (late) GROUP BY activity, late)
SELECT activity AS label, round(sum(share) FILTER (WHERE NOT late), 6) AS share_early, round(sum(share) FILTER (WHERE late), 6) AS share_late, CAST(sum(events) FILTER (WHERE NOT late) AS BIGINT) AS events_early, CAST(sum(events) FILTER (WHERE late) AS BIGINT) AS events_late FROM x GROUP BY activity""")
def a9_activity_shares(spark, d):
    log = user_days(spark, d)
    out = statistics.activity_shares({"early": half_month(log, False), "late": half_month(log, True)})
    return rounded(out.select("label", "share_early", "share_late", "events_early", "events_late"))


@query(f"""WITH {USERDAY}, h AS (SELECT variant, right(case_id, 2)::INT > 15 AS late, count(*) AS n FROM seq GROUP BY ALL),
s AS (SELECT variant, late, n * 1.0 / sum(n) OVER (PARTITION BY late) AS share FROM h),
w AS (SELECT variant, coalesce(sum(share) FILTER (WHERE NOT late), 0) AS share_early, coalesce(sum(share) FILTER (WHERE late), 0) AS share_late, sum(share) AS total FROM s GROUP BY variant)
SELECT variant, round(share_early, 6) AS share_early, round(share_late, 6) AS share_late, (SELECT count(*) FROM w) AS distinct_variants FROM w ORDER BY round(total, 12) DESC, string_split(variant, ',') LIMIT 60""")
def a10_variant_shares(spark, d):
    log = user_days(spark, d)
    out = statistics.variant_shares({"early": half_month(log, False), "late": half_month(log, True)})
    return rounded(out.select(text("variant").alias("variant"), "share_early", "share_late", "distinct_variants"))


@query(f"""WITH {USERDAY}, x AS (SELECT 'events per case' AS measure, CAST(len AS DOUBLE) AS x FROM seq UNION ALL SELECT 'duration (h)', {DUR} / 3600 FROM seq)
SELECT measure, count(x) AS count, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, round(min(x), 6) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS q50, round(quantile_cont(x, 0.75), 6) AS q75, round(max(x), 6) AS max FROM x GROUP BY measure""")
def a11_describe(spark, d):
    return rounded(statistics.describe_log(user_days(spark, d)))


@query("""WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS ed FROM lineitem)
SELECT a, b, round(r, 6) AS r FROM (SELECT unnest([{'a': 'l_quantity', 'b': 'l_quantity', 'r': 1.0::DOUBLE}, {'a': 'l_quantity', 'b': 'l_extendedprice', 'r': qe}, {'a': 'l_quantity', 'b': 'l_discount', 'r': qd}, {'a': 'l_extendedprice', 'b': 'l_quantity', 'r': qe}, {'a': 'l_extendedprice', 'b': 'l_extendedprice', 'r': 1.0}, {'a': 'l_extendedprice', 'b': 'l_discount', 'r': ed}, {'a': 'l_discount', 'b': 'l_quantity', 'r': qd}, {'a': 'l_discount', 'b': 'l_extendedprice', 'r': ed}, {'a': 'l_discount', 'b': 'l_discount', 'r': 1.0}], recursive := true) FROM c)""")
def a12_correlate(spark, d):
    return rounded(statistics.correlate(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@query(f"""WITH {USERDAY}, s AS (SELECT case_id, {DUR} AS x FROM seq), t AS (SELECT case_id, x, floor(x)::BIGINT AS w FROM s)
SELECT case_id, CASE WHEN x < 1 THEN CAST(round_even(x * 1000, 0) AS BIGINT) || 'ms' WHEN w < 60 THEN w || 's'
WHEN w < 3600 THEN w // 60 || 'm' || CASE WHEN w % 60 > 0 THEN ' ' || w % 60 || 's' ELSE '' END
WHEN w < 86400 THEN w // 3600 || 'h' || CASE WHEN w % 3600 // 60 > 0 THEN ' ' || w % 3600 // 60 || 'm' ELSE '' END
ELSE w // 86400 || 'd' || CASE WHEN w % 86400 // 3600 > 0 THEN ' ' || w % 86400 // 3600 || 'h' ELSE '' END END AS text FROM t""")
def a13_format_duration(spark, d):
    return statistics.case_spans(user_days(spark, d)).select("case_id", X.format_duration(F.col("duration")).alias("text"))


@query(f"""WITH {USERDAY} SELECT (SELECT count(*) FROM var) AS variants, (SELECT count(*) FROM seq) AS cases, (SELECT count(*) FROM e) AS events,
(SELECT string_agg(DISTINCT activity, ',' ORDER BY activity) FROM e) AS activities, (SELECT string_agg(DISTINCT activity, ',' ORDER BY activity) FROM e WHERE pos = 0) AS starts,
(SELECT string_agg(DISTINCT activity, ',' ORDER BY activity) FROM e JOIN seq USING (case_id) WHERE pos = len - 1) AS ends""")
def a14_activity_sets(spark, d):
    s = statistics.activity_sets(user_days(spark, d))
    return s.select("variants", "cases", "events", text("activities").alias("activities"), text("start_activities").alias("starts"), text("end_activities").alias("ends"))


@query(f"WITH {USERDAY} SELECT 'days' AS model, count(*) AS cases, NULL::BIGINT AS events FROM seq UNION ALL SELECT 'all', NULL, count(*) FROM e")
def a15_stack_scores(spark, d):
    log = user_days(spark, d)
    return statistics.stack_scores([log.cases.agg(F.count("*").alias("cases")).select(F.lit("days").alias("model"), "cases"), log.events.agg(F.count("*").alias("events")).select(F.lit("all").alias("model"), "events")])


@query("SELECT event_id, round((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 3.6e9, 6) AS x FROM events")
def w1_actual_time(spark, d):
    return rounded(timeline.actual_time(user_days(spark, d), "h").select("event_id", "x"))


@query(f"WITH {USERDAY} SELECT event_id, round(CASE WHEN high = low THEN 0 ELSE (epoch_us(ts) - epoch_us(low)) * 100.0 / (epoch_us(high) - epoch_us(low)) END, 6) AS x FROM e JOIN seq USING (case_id)")
def w2_case_time(spark, d):
    return rounded(timeline.case_time(user_days(spark, d), relative=True).select("event_id", "x"))


@query(f"WITH {USERDAY} SELECT event_id, row_number() OVER (ORDER BY ts, low, first_id, case_id, pos) - 1 AS x FROM e JOIN seq USING (case_id)")
def w3_global_order(spark, d):
    return timeline.global_order(user_days(spark, d)).select("event_id", "x")


@query(f"WITH {USERDAY} SELECT event_id, CAST(pos AS INT) AS x FROM e")
def w4_case_position(spark, d):
    return timeline.case_position(user_days(spark, d)).select("event_id", "x")


@query("SELECT CAST(user_id AS VARCHAR) AS row, CAST(row_number() OVER (ORDER BY user_id) - 1 AS INT) AS place, count(*) AS count FROM events GROUP BY user_id")
def w5_ranked_rows(spark, d):
    return timeline.ranked_rows(user_days(spark, d), "resource", "name").select("row", "place", "count")


@query("SELECT event_type AS value, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, event_type) AS INT) AS rank, CAST(least(row_number() OVER (ORDER BY count(*) DESC, event_type), 4) AS INT) AS slot FROM events GROUP BY 1")
def w6_frequency_ranks(spark, d):
    return timeline.frequency_ranks({"log": user_days(spark, d)}, distinct=3)


@query(f"""WITH {USERDAY}, x AS (SELECT {DUR} AS d FROM seq WHERE len > 1), r AS (SELECT d, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS m FROM x)
SELECT (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM seq) AS cases, round(avg(d), 5) AS mean_duration, round(min(d), 5) AS shortest, round(max(d), 5) AS longest, round(max(d) FILTER (WHERE k = m // 2 + 1), 5) AS median_duration FROM r""")
def w7_timeline_statistics(spark, d):
    return rounded(timeline.timeline_statistics(user_days(spark, d)), 5)


@query("""WITH x AS (SELECT ts, epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) > 1800000000 AS new FROM events WHERE event_type = 'purchase'),
g AS (SELECT ts, sum(coalesce(new, true)::INT) OVER (ORDER BY ts) AS k FROM x) SELECT epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM g GROUP BY k""")
def w8_batches(spark, d):
    return timeline.batches(user_days(spark, d), "purchase", 1800).select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT count(*) FILTER (WHERE dayofweek(ts) IN (0, 6)) AS weekend_events FROM events")
def w9_weekends(spark, d):
    return timeline.weekend_events(user_days(spark, d))


@query(f"WITH {USERDAY}, g AS (SELECT case_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY case_id ORDER BY ts) AS gap FROM e) SELECT count(DISTINCT case_id) AS cases FROM g WHERE gap > 7200000000")
def w10_timeouts(spark, d):
    return timeline.timeouts(user_days(spark, d), 7200)


@query(f"WITH {USERDAY} SELECT round(count(*) / greatest((epoch_us(max(low)) - epoch_us(min(low))) / 8.64e10, 1.0), 6) AS cases_per_day FROM seq")
def w11_arrival_rate(spark, d):
    return rounded(timeline.arrival_rate(user_days(spark, d)))


@query(f"WITH {USERDAY}, {EDGES} SELECT a, b, n FROM edges")
def g1_directly_follows(spark, d):
    return G.discover_dfg(user_days(spark, d)).edges


@query(f"""WITH {USERDAY}, x AS (SELECT activity AS a, lead(activity) OVER w AS b, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS s FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos))
SELECT a, b, count(*) AS n, count(s) AS timed, round(avg(s), 5) AS mean_s, round(median(s), 5) AS median_s FROM x WHERE b IS NOT NULL GROUP BY a, b""")
def g2_edge_durations(spark, d):
    return rounded(G.edge_durations(user_days(spark, d)), 5)


@query(f"WITH {USERDAY}, {EDGES} SELECT a, b, n FROM edges UNION ALL SELECT '▶', activity, n_start FROM nodes WHERE n_start > 0 UNION ALL SELECT activity, '■', n_end FROM nodes WHERE n_end > 0")
def g3_all_edges(spark, d):
    return G.all_edges(G.discover_dfg(user_days(spark, d)))


@query(f"""WITH {LINES}, {EDGES}, k AS (SELECT activity FROM nodes ORDER BY n DESC, activity LIMIT (SELECT greatest(round_even(count(*) * 0.6, 0), 1)::BIGINT FROM nodes)),
i AS (SELECT * FROM edges WHERE a IN (FROM k) AND b IN (FROM k)),
r AS (SELECT *, row_number() OVER (ORDER BY n DESC, a, b) AS x, row_number() OVER (PARTITION BY b ORDER BY n DESC, a, b) AS y, row_number() OVER (PARTITION BY a ORDER BY n DESC, a, b) AS z FROM i)
SELECT a, b, n FROM r WHERE x <= (SELECT round_even(count(*) * 0.3, 0) FROM i) OR y = 1 OR z = 1""")
def g4_simplified(spark, d):
    return G.simplified(G.discover_dfg(order_lines(spark, d)), 0.6, 0.3).edges


@query(f"""WITH {USERDAY}, {EDGES} SELECT activity, (SELECT string_agg(b, ',' ORDER BY b) FROM edges WHERE a = activity) AS successors, (SELECT string_agg(a, ',' ORDER BY a) FROM edges WHERE b = activity) AS predecessors FROM nodes""")
def g5_neighbours(spark, d):
    return G.neighbours(G.discover_dfg(user_days(spark, d))).select("activity", text("successors").alias("successors"), text("predecessors").alias("predecessors"))


@query(f"""WITH {USERDAY}, {EDGES}, x AS (SELECT activity AS a, lead(activity) OVER w AS b, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6 AS s FROM e WINDOW w AS (PARTITION BY case_id ORDER BY pos)),
m AS (SELECT a, b, avg(s) AS s FROM x WHERE b IS NOT NULL GROUP BY a, b), q AS (SELECT *, s / max(s) OVER () AS slowness FROM m)
SELECT a, b, n, round(n * 1.0 / max(n) OVER (), 6) AS relative, round(ln(1 + n) / ln(1 + max(n) OVER ()), 6) AS fill, n * 1.0 / max(n) OVER () <= 0.15 AS rare, round(slowness, 6) AS slowness, slowness > 0.66 AS slow FROM edges JOIN q USING (a, b)""")
def g6_map_annotations(spark, d):
    log = user_days(spark, d)
    return rounded(G.map_annotations(G.discover_dfg(log), G.edge_durations(log))[1])


FOOT = """p AS (SELECT x.activity AS a, y.activity AS b FROM nodes x, nodes y),
foot AS (SELECT p.a, p.b, CASE WHEN s.n IS NOT NULL AND t.n IS NOT NULL THEN '‖' WHEN s.n IS NOT NULL THEN '→' WHEN t.n IS NOT NULL THEN '←' ELSE '#' END AS relation FROM p LEFT JOIN edges s ON s.a = p.a AND s.b = p.b LEFT JOIN edges t ON t.a = p.b AND t.b = p.a)"""


@query(f"WITH {CONV}, {EDGES}, {FOOT} SELECT a, b, relation FROM foot")
def g7_footprint(spark, d):
    return G.footprint_of_log(conversations(spark, d))


@query(f"""WITH {CONV}, {EDGES}, {FOOT} SELECT a, max(relation) FILTER (WHERE b = 'assistant') AS assistant, max(relation) FILTER (WHERE b = 'user') AS user FROM foot GROUP BY a""")
def g8_footprint_matrix(spark, d):
    return G.footprint_matrix(G.footprint_of_log(conversations(spark, d)), ["assistant", "user"])


def _half_foot(late: bool) -> str:
    test = "right(case_id, 2)::INT > 15" if late else "right(case_id, 2)::INT <= 15"
    k = "2" if late else "1"
    return f"""n{k} AS (SELECT DISTINCT activity FROM e WHERE {test}), d{k} AS (SELECT DISTINCT a, b FROM (SELECT activity AS a, lead(activity) OVER (PARTITION BY case_id ORDER BY pos) AS b FROM e WHERE {test}) WHERE b IS NOT NULL)"""


@query(f"""WITH {USERDAY}, {_half_foot(False)}, {_half_foot(True)}, u AS (SELECT activity FROM n1 UNION SELECT activity FROM n2), p AS (SELECT x.activity AS a, y.activity AS b FROM u x, u y),
f AS (SELECT a, b, CASE WHEN (a, b) IN (FROM d1) AND (b, a) IN (FROM d1) THEN 'p' WHEN (a, b) IN (FROM d1) THEN 'r' WHEN (b, a) IN (FROM d1) THEN 'l' ELSE '#' END AS l, CASE WHEN (a, b) IN (FROM d2) AND (b, a) IN (FROM d2) THEN 'p' WHEN (a, b) IN (FROM d2) THEN 'r' WHEN (b, a) IN (FROM d2) THEN 'l' ELSE '#' END AS r FROM p)
SELECT count(*) AS cells, count(*) FILTER (WHERE l <> r) AS differing, round(1 - count(*) FILTER (WHERE l <> r) * 1.0 / count(*), 6) AS fitness FROM f""")
def g9_compare_footprints(spark, d):
    log = user_days(spark, d)
    return rounded(G.compare_footprints(G.footprint_of_log(half_month(log, False)), G.footprint_of_log(half_month(log, True)))[1])


@query(f"WITH {OC} SELECT t AS type, coalesce((SELECT count(*) FROM ob WHERE type = t), 0) AS objects FROM (VALUES ('order'), ('customer'), ('part'), ('supplier'), ('invoice')) v(t)")
def o1_counts_by_type(spark, d):
    return objects.counts_by_type(order_objects(spark, d))


@query(f"WITH {OC} SELECT DISTINCT event_id, activity FROM re WHERE object_id = 'c7'")
def o2_events_of(spark, d):
    return objects.events_of(order_objects(spark, d), "c7").select("event_id", "activity")


@query(f"""WITH {OC}, x AS (SELECT DISTINCT object_id, event_id, activity, ts FROM re WHERE type = 'order'),
y AS (SELECT event_id, string_agg(object_id, ', ' ORDER BY ix, object_id) AS parts FROM (SELECT DISTINCT event_id, object_id, ix FROM rel WHERE type = 'part') GROUP BY event_id)
SELECT object_id AS case_id, CAST(row_number() OVER (PARTITION BY object_id ORDER BY ts, activity, event_id) - 1 AS INT) AS pos, activity, parts FROM x LEFT JOIN y USING (event_id)""")
def o3_flatten(spark, d):
    return objects.flatten(order_objects(spark, d), "order").events.select("case_id", "pos", "activity", F.try_element_at("others", F.lit("ocel:part")).alias("parts"))


@query(f"""WITH {OC}, x AS (SELECT type, activity AS a, lead(activity) OVER (PARTITION BY type, object_id ORDER BY ts, activity, event_id, ix) AS b FROM re)
SELECT type, a, b, count(*) AS n FROM x WHERE b IS NOT NULL GROUP BY ALL""")
def o4_object_centric_dfg(spark, d):
    return objects.object_centric_dfg(order_objects(spark, d))[0]


@query(f"WITH {OC} SELECT activity, type, count(*) AS n FROM re GROUP BY ALL")
def o5_objects_at(spark, d):
    return objects.objects_at(order_objects(spark, d))
