"""Merkle manifest of a dataset: a content-addressed store of digest -> children, and proofs by descending from the root.

Leaves of one language, in the order of doc_id, are the lowest level of that language's tree; eight consecutive nodes
become one. Ranks come from range-sorted partitions and the partitions' counts, so no task orders a language. Each level
is one grouping whose groups have at most eight rows, written as a table (level, digest, children) that is read by digest.

Proofs: requests go down from the root. A request for a leaf is its rank, whose base-8 digits choose the child at each
node; the children that are not chosen are the path's segment for that node. Requests that share a prefix of digits share
the descent: the frontier holds one row for each node that some request passes, so the root is read once and not once per
leaf. Segments are put in front of those above them, so that at the leaf they are in order from the leaf to the root.

Defined results: a null field hashes as ``-``; null doc_ids come first among the leaves of their language, equal doc_ids
are ordered by leaf digest, and equal rows (whose order cannot matter) by a row number; a null language is a language of
its own and comes first; an empty table gives an empty result; a table of one row has that leaf as root and empty proofs
(the hash of the empty text); very long texts are hashed whole; columns besides the five of a leaf do not matter; no row
is tampered with whose doc_id is null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .runtime import ascii_lower, cut, look_up

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_OUT = 8
SEGMENTS = "array<struct<left:string,right:string>>"


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row's fields, each as its UTF-8 length, a colon and the value, or ``-`` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")) for s in (c.cast("string") for c in fields)]
    return F.sha2(F.concat(*parts), 256)


@dataclass
class Manifest:
    """leaves: tree_, rank_, size_, the digest and the columns carried along; store: level -> digest, children; trees: tree_, place_,
    size_ and subroot; root (null for an empty table); heights: levels of the tallest language tree and of the tree over the languages.

    Levels of language trees count from 1, those of the tree over the languages from TOP + 1.
    """

    leaves: DataFrame
    store: dict[int, DataFrame]
    trees: DataFrame
    root: str | None
    heights: tuple[int, int]


TOP = 1000


def tree_of(group: str) -> Column:
    """The name of a group's tree, never null: null comes first, the others in the order of their bytes."""
    return F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))


def ranked(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """rows with rank_, their place from 0 within the group in the order of keys, and size_, the rows of the group."""
    dealt = cut(rows.repartitionByRange(group, *keys).sortWithinPartitions(group, *keys).withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id()}), "merkle-order")
    runs = dealt.groupBy(group, "part_").agg(F.count("*").alias("n_"), F.min("at_").alias("low_"))  # a group's rows in one partition are one run
    before = W.partitionBy(group).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    bases = runs.select(group, "part_", "low_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"), F.sum("n_").over(W.partitionBy(group)).alias("size_"))
    placed = look_up(dealt, cut(bases, "merkle-runs"), [group, "part_"])
    return placed.withColumn("rank_", F.col("at_") - F.col("low_") + F.col("base_")).drop("part_", "at_", "low_", "base_")


def _grow(nodes: DataFrame, group: str, most: int, level: int, store: dict[int, DataFrame]) -> tuple[DataFrame, int]:
    """Joins up nodes (group, i_, digest, size_) until each group has one; a table per level goes into store. Gives the tops and the number of levels."""
    tops, height, left = None, 0, most
    while True:
        alone = F.ceil(F.col("size_") / FAN_OUT**height) == 1
        tops = nodes.filter(alone) if tops is None else tops.unionByName(nodes.filter(alone))
        if left <= 1:
            return tops, height
        height, left = height + 1, -(-left // FAN_OUT)
        joined = nodes.filter(~alone).groupBy(group, F.expr(f"i_ div {FAN_OUT}").alias("i_"), "size_").agg(F.array_sort(F.collect_list(F.struct("i_", "digest"))).alias("run_"))
        kids = F.transform("run_", lambda x: x["digest"])
        grown = cut(joined.select(group, "i_", "size_", F.sha2(F.concat_ws("", kids), 256).alias("digest"), kids.alias("children")), "merkle-level")
        store[level + height] = grown.select("digest", "children")
        nodes = grown.select(group, "i_", "digest", "size_")


def build(rows: DataFrame, leaf: str = "leaf", group: str = "lang", keys: tuple[str, ...] = ("doc_id", "leaf")) -> Manifest:
    """The manifest of rows that carry a leaf digest and a group; other columns go along with the leaves."""
    known = cut(rows.withColumns({"tree_": tree_of(group), "row_": F.monotonically_increasing_id()}), "merkle-leaves")
    leaves = cut(ranked(known, "tree_", [*keys, "row_"]).drop("row_"), "merkle-ranked")
    store: dict[int, DataFrame] = {}
    most = leaves.agg(F.max("size_")).first()[0]
    if most is None:
        return Manifest(leaves, store, leaves.select("tree_", F.lit(0).alias("place_"), "size_", F.col(leaf).alias("subroot")), None, (0, 0))
    tops, low = _grow(leaves.select("tree_", F.col("rank_").alias("i_"), F.col(leaf).alias("digest"), "size_"), "tree_", most, 0, store)
    placed = ranked(tops.select("tree_", "digest", F.col("size_").alias("rows_"), F.lit(0).alias("all_")), "all_", ["tree_"])
    trees = cut(placed.select("tree_", F.col("rank_").alias("place_"), F.col("rows_").alias("size_"), F.col("digest").alias("subroot"), F.col("size_").alias("langs_")), "merkle-trees")
    langs = trees.agg(F.max("langs_")).first()[0]
    root, high = _grow(trees.select(F.lit(0).alias("all_"), F.col("place_").alias("i_"), F.col("subroot").alias("digest"), F.col("langs_").alias("size_")), "all_", langs, TOP, store)
    return Manifest(leaves, store, trees.drop("langs_"), root.first()["digest"], (low, high))


def _met(frontier: DataFrame, records: DataFrame, tall: Column) -> DataFrame:
    """The frontier (i_, digest, above, ...) with the children that the digests of tall trees have in the store; null for the others, which wait."""
    known = records.dropDuplicates(["digest"]).withColumnRenamed("digest", "asked_")
    return frontier.withColumn("asked_", F.when(tall, F.col("digest"))).join(known, "asked_", "left").drop("asked_")


def _segment(kids: Column, at: Column) -> Column:
    """What is left and right of the child at place ``at`` (from 0)."""
    return F.struct(F.concat_ws("", F.slice(kids, F.lit(1), at)).alias("left"), F.concat_ws("", F.slice(kids, at + 2, F.lit(FAN_OUT))).alias("right"))


def _below(met: DataFrame) -> DataFrame:
    """One row per child of the nodes met, its own segment in front of those above; nodes that wait stay as they are."""
    kept = [c for c in met.columns if c not in ("digest", "children", "above", "i_")]
    at, above, kids = F.col("i_"), F.col("above"), F.col("children")
    node = lambda i, digest, path: F.struct(i.alias("i_"), digest.alias("digest"), path.alias("above"))
    down = F.transform(kids, lambda x, k: node(at * FAN_OUT + k, x, F.concat(F.array(_segment(kids, k)), above)))
    rows = met.select(*kept, F.explode(F.when(kids.isNull(), F.array(node(at, F.col("digest"), above))).otherwise(down)).alias("x_"))
    return rows.select(*kept, "x_.*")


def prove(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The leaves requested (tree_ and rank_; all without ``requests``) with path: left and right siblings for each level, from the leaf to the root.

    Only nodes that requests pass are read: the digit prefixes of the requests, one table per level, hold back the rest.
    """
    leaves, passed = m.leaves, {}
    if m.root is None:
        return leaves.withColumn("path", F.lit(None).cast(SEGMENTS))
    low, high = m.heights
    if requests is not None:
        passed[0] = cut(requests.select("tree_", F.col("rank_").alias("i_")).distinct(), "merkle-wanted")
        for k in range(1, low + 1):
            passed[k] = cut(passed[k - 1].select("tree_", F.expr(f"i_ div {FAN_OUT}").alias("i_")).distinct(), "merkle-wanted")
        leaves = leaves.join(passed[0].withColumnRenamed("i_", "rank_"), ["tree_", "rank_"], "left_semi")
    frontier = leaves.sparkSession.range(1).select(F.lit(0).cast("long").alias("i_"), F.lit(m.root).alias("digest"), F.array().cast(SEGMENTS).alias("above"))
    for k in range(high, 0, -1):
        frontier = _below(_met(frontier, m.store[TOP + k], F.lit(True)))
    frontier = m.trees.select("tree_", "size_", F.col("place_").alias("i_")).join(frontier, "i_").withColumn("i_", F.lit(0).cast("long"))
    met = frontier.withColumn("children", F.lit(None).cast("array<string>"))  # if all trees have one leaf
    for k in range(low, 0, -1):
        if requests is not None:
            frontier = frontier.join(passed[k], ["tree_", "i_"], "left_semi")
        met = _met(frontier, m.store[k], F.ceil(F.col("size_") / FAN_OUT ** (k - 1)) > 1)
        frontier = _below(met) if k > 1 else met
    paths = met.select("tree_", F.col("i_").alias("up_"), "children", "above")
    met = leaves.withColumn("up_", F.expr(f"rank_ div {FAN_OUT}")).join(paths, ["tree_", "up_"])
    own = F.array(_segment(F.col("children"), F.expr(f"cast(rank_ % {FAN_OUT} as int)")))
    return met.withColumn("path", F.when(F.col("children").isNull(), F.col("above")).otherwise(F.concat(own, "above"))).drop("up_", "children", "above")


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the path, from the leaf to the root."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"]))), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def documents_manifest(docs: DataFrame) -> tuple[Manifest, DataFrame]:
    """The manifest of documents, and every leaf with its path; the leaves carry doc_id and shown, the digest of what a reader got."""
    doc_id, source, lang, n_chars, text = (F.col(c) for c in FIELDS)
    tampered = F.crc32(doc_id.cast("string")) % 3 == 0
    leaf = leaf_digest([doc_id, source, lang, n_chars, text])
    shown = F.when(tampered & text.isNotNull(), leaf_digest([doc_id, source, lang, n_chars, ascii_lower(text)])).otherwise(F.col("leaf"))
    m = build(docs.select(doc_id, lang, leaf.alias("leaf"), text, source, n_chars).select("doc_id", "lang", "leaf", shown.alias("shown")))
    return m, prove(m)


def verify_documents(docs: DataFrame) -> DataFrame:
    """Per document: leaf, subroot, root, digest of its proof, and whether what a reader got folds to the root."""
    m, proved = documents_manifest(docs)
    found = look_up(proved, m.trees.select("tree_", "subroot"), "tree_")
    root = F.lit(m.root).cast("string")
    folded = fold(F.col("shown"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
