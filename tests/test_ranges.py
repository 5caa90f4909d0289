"""Groups that hold a third of all rows, and runs over a whole table: the same rows as by plain ordering, spread over tasks."""

import random
import re
from statistics import median

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helpers import as_dict
from tracemill import log as logs
from tracemill.log import log_from_table
from tracemill.operators import dfg, objects, ranges, timeline
from tracemill.operators.variants import variants


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    hot = [("hot", k, rng.choice("abc"), rng.choice([None, k])) for k in range(3000)]
    cold = [(f"g{k % 300}", k // 300, rng.choice("abc"), k) for k in range(6000)]
    both = hot + cold + [(None, k, "n", k) for k in range(50)]
    rng.shuffle(both)
    return spark.createDataFrame(both, "g string, at long, x string, y long").repartition(7)


@pytest.fixture(params=[1, 7, 40])
def partitions(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def everything(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_neighbours_of_hot_groups(rows, partitions):
    own = W.partitionBy("g").orderBy("at")
    plain = rows.withColumns({"x0": F.lag("x").over(own), "y0": F.lag("y").over(own), "x1": F.lead("x").over(own)})
    split = ranges.with_neighbours(rows, ["g"], [F.col("at")], {"x0": "x", "y0": "y"}, {"x1": "x"}, limit=1000)
    assert split.columns == plain.columns and everything(split) == everything(plain)
    assert everything(ranges.with_neighbours(rows, ["g"], [F.col("at")], {"x0": "x", "y0": "y"}, {"x1": "x"})) == everything(plain)


def test_places_in_hot_groups(rows, partitions):
    plain = rows.withColumn("p", F.row_number().over(W.partitionBy("g").orderBy("at")).cast("long") - 1)
    assert everything(ranges.with_place(rows, ["g"], [F.col("at")], "p", limit=1000)) == everything(plain)


def test_a_hot_group_is_several_pieces(spark, rows):
    spark.conf.set("spark.sql.shuffle.partitions", 12)
    pieces = ranges._pieces(rows.filter("g = 'hot'"), ["g"], [F.col("at")])
    sizes = [r["count"] for r in pieces.groupBy("part_").count().collect()]
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(sizes) >= 10 and max(sizes) <= 2 * median(sizes)


def test_empty_tables(rows):
    none = rows.limit(0)
    assert ranges.with_neighbours(none, ["g"], [F.col("at")], {"b": "x"}, {}).count() == 0
    assert ranges.runs(none.select("at", "y"), "at", F.lit(1), "y").count() == 0


@pytest.mark.parametrize("values", [[5], [0, 1, 2, 3], [0, 10, 11, 12, 30, 31, 100], list(range(0, 4000, 3)), [k * k for k in range(200)]])
def test_runs_over_borders(spark, partitions, values):
    for gap in (1, 3, 50):
        want, last = [], None
        for v in values:
            if last is None or v - last > gap:
                want.append([v, v, 0])
            want[-1][1], want[-1][2], last = v, want[-1][2] + 2, v
        found = ranges.runs(spark.createDataFrame([(v, 2) for v in values], "v long, w long"), "v", F.lit(gap), "w")
        assert sorted(map(list, found.collect())) == want


@pytest.fixture
def hot_log(spark):
    rng = random.Random(2)
    made = [("hot", "abc"[k * k % 3], k, 60 * k + rng.choice([0, 30])) for k in range(2000)] + [(f"c{k % 400}", rng.choice("abc"), k, 70 * k) for k in range(4000)]
    table = spark.createDataFrame(made, "case_id string, activity string, k long, s long").withColumn("ts", F.timestamp_seconds("s"))
    return lambda limit=None: log_from_table(table, "case_id", "activity", "ts", order_by=["k"], hot_rows=limit)


def test_a_hot_case_gives_the_same_graph(hot_log, monkeypatch):
    def found(log):
        g = dfg.discover_dfg(log)
        return [everything(x) for x in (g.nodes, g.edges, g.totals, dfg.edge_durations(log).select("a", "b", "n", "timed", F.round("mean_s", 6), "median_s"), timeline.timeouts(log, 65), log.events)]

    plain = found(hot_log())
    monkeypatch.setattr(ranges, "HOT", 500)
    assert found(hot_log(500)) == plain


def test_graph_by_neighbours_is_that_of_variants(hot_log):
    log, one = hot_log(), lambda g: [everything(g.nodes), everything(g.edges), everything(g.totals)]
    assert one(dfg.discover_dfg(log)) == one(dfg.dfg_of_variants(variants(log)))


def test_a_hot_object_gives_the_same_map(spark, monkeypatch):
    rng = random.Random(3)
    events = [(f"e{k}", rng.choice("abcd"), k) for k in range(1500)]
    related = [(f"e{k}", o, j) for k in range(1500) for j, o in enumerate(["hot", f"o{k % 200}", f"p{k % 90}"])]
    e = spark.createDataFrame(events, "event_id string, activity string, ord long")
    r = spark.createDataFrame(related + related[:5], "event_id string, object_id string, rel_ix int")
    o = r.select("object_id").distinct().withColumn("type", F.substring("object_id", 1, 1))
    log = objects.object_log(e, o, r)
    plain = [everything(x) for x in objects.object_centric_dfg(log)]
    monkeypatch.setattr(ranges, "HOT", 300)
    assert [everything(x) for x in objects.object_centric_dfg(log)] == plain


def test_batches_take_no_single_task(spark, sf):
    """Exchanges into one partition hold one row per partition or per task at most: they stand above an aggregation."""
    from tracemill import queries as Q

    for name in ("w8_batches", "w3_global_order", "a2_variant_table", "f9_coverage", "g2_edge_durations", "w10_timeouts"):
        plan = Q.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
        for k, line in enumerate(plan):
            if "Exchange SinglePartition" in line:
                assert re.search(r"(Hash|Sort|ObjectHash)Aggregate|Project", plan[k + 1]), (name, plan[k + 1])
        assert not any("Session" in line for line in plan), name


def test_variants_of_the_log_are_as_before(hot_log):
    assert sum(as_dict(variants(hot_log())).values()) == 401


def test_large_logs_are_dealt_over_more_partitions(spark, monkeypatch):
    """A task orders about as many rows whatever the table's size, and the graph is that of the table ordered whole."""
    rows = spark.range(20_000).select((F.col("id") % 5_000).cast("string").alias("case"), F.concat(F.lit("a"), (F.hash("id") % 3).cast("string")).alias("activity"), F.col("id").alias("at"))
    plain = dfg.discover_dfg(log_from_table(rows, "case", "activity", order_by=["at"]))
    expected = sorted(map(tuple, plain.edges.collect()))
    monkeypatch.setattr(logs, "TASK_ROWS", 1_000, raising=False)
    made = log_from_table(rows, "case", "activity", order_by=["at"])
    sizes = [r["count"] for r in made.events.groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert sum(sizes) == 20_000 and len(sizes) == 20 and max(sizes) < 2_000
    assert sorted(map(tuple, dfg.discover_dfg(made).edges.collect())) == expected
