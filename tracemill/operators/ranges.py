"""Ranks, running sums, quantiles, runs and neighbours without a task that holds a whole table or a whole group.

Rows are dealt to partitions by range and sorted there; the partitions' totals, one row each, give what lies before, and
their first and last rows what lies on the other side of a border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut


def _dealt(rows: DataFrame, keys: list[Column], weight: Column) -> tuple[DataFrame, DataFrame]:
    """rows in order with part_ and at_, written so that both stay as they are; and per partition the weight of all partitions before it."""
    order = cut(rows.withColumn("weight_", weight), "weighed")  # borders are found in a sample: without a table the rows would be made twice
    dealt = cut(order.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), "ranges")
    before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    parts = dealt.groupBy("part_").agg(F.sum("weight_").alias("sum_"), F.min("at_").alias("low_"))
    return dealt, parts.select("part_", "low_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))


def with_rank(rows: DataFrame, keys: list[Column], name: str) -> DataFrame:
    """rows with their place, from 0, in the order of ``keys`` as ``name``."""
    dealt, parts = _dealt(rows, keys, F.lit(1))
    return dealt.join(F.broadcast(parts), "part_").withColumn(name, F.col("at_") - F.col("low_") + F.col("base_")).drop("part_", "at_", "low_", "base_", "weight_")


def with_sum_before(rows: DataFrame, keys: list[Column], weight: str, name: str) -> DataFrame:
    """rows with the sum of ``weight`` over all rows before them in the order of ``keys`` as ``name``."""
    dealt, parts = _dealt(rows, keys, F.col(weight))
    inside = W.partitionBy("part_").orderBy("at_").rowsBetween(W.unboundedPreceding, -1)
    summed = dealt.withColumn(name, F.coalesce(F.sum("weight_").over(inside), F.lit(0)))
    return summed.join(F.broadcast(parts), "part_").withColumn(name, F.col(name) + F.col("base_")).drop("part_", "at_", "low_", "base_", "weight_")


def quantiles(rows: DataFrame, groups: list[str], value: str, shares: dict[str, float], weight: str | None = None) -> DataFrame:
    """groups and, for each name of ``shares``, the quantile of ``value`` in the group, interpolated between neighbours; nulls do not count.

    Equal values are counted first (or have their counts in ``weight``); the ordered table has one row per group and distinct value.
    """
    known = rows.filter(F.col(value).isNotNull())
    count = F.count("*") if weight is None else F.sum(weight)
    counted = known.groupBy(*groups, F.col(value).alias("value_")).agg(count.alias("k_"))
    placed = with_sum_before(counted, [*map(F.col, groups), F.col("value_")], "k_", "above_")
    sizes = placed.groupBy(*groups).agg(F.sum("k_").alias("size_"), F.min("above_").alias("from_"))
    both = placed.join(sizes, groups) if groups else placed.crossJoin(F.broadcast(sizes))  # one row
    low = F.col("above_") - F.col("from_")
    at = {n: F.lit(q) * (F.col("size_") - 1) for n, q in shares.items()}
    holds = lambda i: (low <= i) & (i < low + F.col("k_"))
    picks = [F.max(F.when(holds(f(x)), F.col("value_"))).alias(f"{n}_{k}_") for n, x in at.items() for k, f in (("a", F.floor), ("b", F.ceil))]
    found = both.groupBy(*groups, "size_").agg(*picks)
    between = [(F.col(f"{n}_a_") + (F.col(f"{n}_b_") - F.col(f"{n}_a_")) * (x - F.floor(x))).alias(n) for n, x in at.items()]
    return found.select(*groups, *between)


#: Rows from which on a group is spread over ranges instead of being ordered in one task.
HOT = 1_000_000


def hot_groups(rows: DataFrame, group: list[str], limit: int | None = None) -> DataFrame | None:
    """The groups of over ``limit`` rows, fewer than rows / limit of them; nothing if there are none. Groups named by a null are never among them."""
    limit = HOT if limit is None else limit
    found = cut(rows.groupBy(*group).agg(F.count("*").alias("rows_")).filter(F.col("rows_") > limit).select(*group), "hot")
    return found if found.limit(1).count() else None


def _pieces(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """rows of hot groups in order, with the partition they are in and their place: a group is as many pieces as it has partitions."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, group), *order]
    return cut(cut(rows, "hot-rows").repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), "pieces")


def with_neighbours(rows: DataFrame, group: list[str], order: list[Column], before: dict[str, str], after: dict[str, str], limit: int | None = None) -> DataFrame:
    """rows with columns of the row before and of the row after in the group, by new name; null at the group's ends.

    Most groups are ordered in one task each, by one exchange. Those of over ``limit`` rows are ordered over ranges of
    (group, order); the first and last row of each piece are carried over to the piece before and after.
    """
    own = W.partitionBy(*group).orderBy(*order)
    near = lambda df: df.withColumns({n: F.lag(c).over(own) for n, c in before.items()} | {n: F.lead(c).over(own) for n, c in after.items()})
    hot = hot_groups(rows, group, limit)
    if hot is None:
        return near(rows)
    pieces = _pieces(rows.join(F.broadcast(hot), group, "left_semi"), group, order)  # fewer than rows / limit groups
    first, last = (F.struct(F.lit(0), *(F.col(c).alias(n) for n, c in x.items())) for x in (after, before))
    borders = pieces.groupBy("part_", *group).agg(F.min("at_").alias("low_"), F.max("at_").alias("high_"), F.min_by(first, "at_").alias("first_"), F.max_by(last, "at_").alias("last_"))
    along = W.partitionBy(*group).orderBy("part_")  # a row per piece
    borders = borders.select("part_", *group, "low_", "high_", F.lag("last_").over(along).alias("back_"), F.lead("first_").over(along).alias("next_"))
    inside = W.partitionBy("part_", *group).orderBy("at_")
    met = pieces.withColumns({n: F.lag(c).over(inside) for n, c in before.items()} | {n: F.lead(c).over(inside) for n, c in after.items()})
    met = met.join(F.broadcast(borders), ["part_", *group])  # as many rows as partitions and hot groups
    over = {n: F.when(F.col("at_") == F.col("low_"), F.col(f"back_.{n}")).otherwise(F.col(n)) for n in before}
    over |= {n: F.when(F.col("at_") == F.col("high_"), F.col(f"next_.{n}")).otherwise(F.col(n)) for n in after}
    spread = met.withColumns(over).drop("part_", "at_", "low_", "high_", "back_", "next_")
    return near(rows.join(F.broadcast(hot), group, "left_anti")).unionByName(spread)


def with_place(rows: DataFrame, group: list[str], order: list[Column], name: str, limit: int | None = None) -> DataFrame:
    """rows with their place, from 0, in the group; groups of over ``limit`` rows are numbered over ranges."""
    near = lambda df: df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long") - 1)
    hot = hot_groups(rows, group, limit)
    if hot is None:
        return near(rows)
    pieces = _pieces(rows.join(F.broadcast(hot), group, "left_semi"), group, order)
    sizes = pieces.groupBy("part_", *group).agg(F.min("at_").alias("low_"), F.count("*").alias("k_"))
    along = W.partitionBy(*group).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # a row per piece
    sizes = sizes.select("part_", *group, "low_", F.coalesce(F.sum("k_").over(along), F.lit(0)).alias("base_"))
    spread = pieces.join(F.broadcast(sizes), ["part_", *group]).withColumn(name, F.col("at_") - F.col("low_") + F.col("base_")).drop("part_", "at_", "low_", "base_")
    return near(rows.join(F.broadcast(hot), group, "left_anti")).unionByName(spread)


def runs(rows: DataFrame, value: str, gap: Column, weight: str) -> DataFrame:
    """first, last, n: runs of a table's distinct values in order, a new one where ``value`` is over ``gap`` more than the value before; n sums ``weight``.

    Runs are found within ranges; one that goes over a border is told by the last value before it, and its parts are added up.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(cut(rows, "values").repartitionByRange(n, value).sortWithinPartitions(value).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), "runs")
    inside = W.partitionBy("part_").orderBy("at_")
    parts = dealt.groupBy("part_").agg(F.max(value).alias("high_"))
    back = parts.select("part_", F.lag("high_").over(W.orderBy("part_")).alias("back_"))  # one row per partition
    met = dealt.withColumn("back_in_", F.lag(value).over(inside)).join(F.broadcast(back), "part_").withColumn("back_", F.coalesce("back_in_", "back_"))
    begun = met.withColumn("new_", (F.col("back_").isNull() | (F.col(value) - F.col("back_") > gap)).cast("int"))
    begun = begun.withColumn("run_", F.sum("new_").over(inside))
    within = begun.groupBy("part_", "run_").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.sum(weight).alias("n"))
    before = W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    bases = within.groupBy("part_").agg(F.max("run_").alias("k_")).select("part_", F.coalesce(F.sum("k_").over(before), F.lit(0)).alias("base_"))
    numbered = within.join(F.broadcast(bases), "part_").withColumn("run_", F.col("run_") + F.col("base_"))
    return numbered.groupBy("run_").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("run_")
