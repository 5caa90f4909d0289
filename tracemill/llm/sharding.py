"""Sharding by histogram sort, with DataFrame functions alone.

Rows are ordered by (hash of the text, doc_id, row number), so that equal texts lie side by side. Splitters are found
without sorting: the exact bytes in the slots of a grid over the key space are counted, then only the slots that hold
a splitter are counted on a grid 4096 times finer, until every splitter's bytes below are within its tolerance or its
slot holds one row alone. A hot text is split by doc_id, and rows that agree in both by their row numbers. Besides the
splitters between shards there are looser ones that cut the table into tasks of about TASK_ROWS rows. Then rows are
exchanged once, each to the partition between its splitters, sorted there, and numbered with the counts of the
partitions before them.

The law is ``bytes``: shard sizes differ by little more than the tolerance or one row.

Defined results: null text counts 0 bytes and crc 0; null doc_id sorts first; repeated rows get slots of their
own and are split between shards like others; of ties in size none matters, as the order is that of the keys; a very
long text is one row and is never split; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut

DIGIT = 12
KEY_BITS = 64
KEY = ("h", "d", "r")
LEVELS_PER_PART = -(-KEY_BITS // DIGIT)
TASK_ROWS, TASK_TOLERANCE = 4_000_000, 0.25
MOST_TASKS = 1024  # one task then holds more rows than TASK_ROWS, and sorts them by spilling


def _digit(level: int) -> Column:
    """The level-th digit of the 192-bit key (h, d, r), all shifted to unsigned order."""
    part, at = KEY[level // LEVELS_PER_PART], level % LEVELS_PER_PART
    shift = max(0, KEY_BITS - DIGIT * (at + 1))
    width = min(DIGIT, KEY_BITS - DIGIT * at)
    return F.shiftrightunsigned(F.col(part).bitwiseXOR(F.lit(-(1 << 63))), shift).bitwiseAND(F.lit((1 << width) - 1))


def find_splitters(keys: DataFrame, marks: list[tuple[float, float]]) -> list[tuple[int, ...]]:
    """A splitter for each mark (share of all bytes that shall lie below it, tolerated share), as a prefix of key digits.

    A row belongs below a splitter if its digits compare less. keys: h, d, r, size. Each round reads one small table of
    counts: 4096 rows at most for each slot that is looked into, and loose marks are nearly all settled in the first round.
    """
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    levels = len(KEY) * LEVELS_PER_PART
    open_ = {j: ((), 0) for j in range(len(marks))}  # prefix of the slot that holds splitter j, bytes below that slot
    found: dict[int, tuple[int, ...]] = {}
    for level in range(levels):
        if not open_:
            break
        inside = F.lit(False)
        for p in sorted({p for p, _ in open_.values()}):
            here = F.lit(True)
            for k, v in enumerate(p):
                here = here & (_digit(k) == v)
            inside = inside | here
        path = [_digit(k).cast("int").alias(f"k{k}") for k in range(level + 1)]
        rows = keys.filter(inside).groupBy(*path).agg(F.sum("size").alias("size"), (F.count("*") == 1).alias("one")).collect()
        slots: dict[tuple, list] = {}
        for r in sorted(rows):
            full = tuple(r[f"k{k}"] for k in range(level + 1))
            slots.setdefault(full[:-1], []).append((full, r["size"], r["one"]))
        still = {}
        for j, (prefix, below) in open_.items():
            target, slack = (total * x for x in marks[j])
            for full, size, one in slots.get(prefix, []):
                if below + size < target:
                    below += size
                    continue
                after = full[:-1] + (full[-1] + 1,)
                near = min((abs(below - target), full), (abs(below + size - target), after))
                if near[0] <= slack or one or level == levels - 1:
                    found[j] = near[1]
                else:
                    still[j] = (full, below)
                break
            else:
                found[j] = prefix[:-1] + (prefix[-1] + 1,) if prefix else (1 << DIGIT,)
        open_ = still
    return [found[j] for j in range(len(marks))]


def _at_or_above(splitter: tuple[int, ...]) -> Column:
    out = F.lit(True)
    for k in reversed(range(len(splitter))):
        out = (_digit(k) > splitter[k]) | (_digit(k) == splitter[k]) & out
    return out


def _number_below(splitters: list[tuple[int, ...]]) -> Column:
    """How many splitters a row is not below: those of one digit by a table, finer ones one by one."""
    coarse = sorted(s[0] for s in splitters if len(s) == 1)
    out = F.lit(0)
    if coarse:
        out = F.element_at(F.lit([bisect_right(coarse, x) for x in range(1 << DIGIT)]), _digit(0).cast("int") + 1)
    for s in splitters:
        if len(s) > 1:
            out = out + F.when(_at_or_above(s), 1).otherwise(0)
    return out


def shard_by_bytes(docs: DataFrame, shards: int = 24, tolerance: float = 0.0005) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("h"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"))
    keys = cut(rows.withColumn("r", F.monotonically_increasing_id()), "shard-keys")
    tasks = min(MOST_TASKS, 1 + keys.count() // TASK_ROWS)
    marks = [(j / shards, tolerance / shards) for j in range(1, shards)] + [(j / tasks, TASK_TOLERANCE / tasks) for j in range(1, tasks)]
    splitters = find_splitters(keys, marks)
    # shard and task never fall from one row to the next, so their sum names the rows between two splitters
    placed = keys.withColumn("shard", _number_below(splitters[: shards - 1])).withColumn("part", F.col("shard") + _number_below(splitters[shards - 1 :]))
    dealt = placed.repartitionById(shards + tasks - 1, "part").sortWithinPartitions(*KEY)
    dealt = cut(dealt.withColumn("at", F.monotonically_increasing_id()).drop(*KEY), "shard-rows")
    runs = dealt.groupBy("part", "shard").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before, base = {}, []
    for r in sorted(runs.collect()):  # at most one row for each of the partitions
        base.append((r["part"], r["first"] - before.get(r["shard"], 0)))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    bases = docs.sparkSession.createDataFrame(base, "part int, base long")
    return dealt.join(F.broadcast(bases), "part").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("base")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
