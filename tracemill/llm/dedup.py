"""Exact deduplication by skew-safe combining, with DataFrame functions alone.

Texts are equal when identical after lower-casing A-Z. Grouping keys hold the whole text next to its digest, so
every stage compares full content. Spark's partial aggregation removes copies inside a partition before anything
is shuffled; salted groups are merged next, so that a text held by a third of all rows is spread over ``salts``
tasks; the salts' winners, at most ``salts`` per text, are combined last. Documents then look up their group by
SHA-256, salted again, and only groups of more than one document are looked up at all; this look-up trusts the digest,
as the groups it reads are already told apart by content.

Defined results: null counts as empty; the largest doc_id of a group stays, a null doc_id only if no other is
there; repeated rows with one doc_id are members of their group each, and all of those with the kept doc_id are
marked kept by the operator; one doc_id with several texts is judged per text; a text of any length (up to Spark's 2 GB
a row) is compared whole; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ascii_lower, free_name


def _salt(salts: int):
    """A salt by row number, so that rows without ids of their own are dealt, too; what comes out does not depend on it."""
    return F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt")


def exact_groups(docs: DataFrame, salts: int = 16) -> DataFrame:
    """Groups of equal texts with over one member: text_sha256, keep_id, group_size."""
    rows = docs.select("doc_id", ascii_lower(F.coalesce("text", F.lit(""))).alias("content"))
    rows = rows.select("doc_id", "content", F.sha2("content", 256).alias("text_sha256"), _salt(salts))
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    merged = salted.groupBy("text_sha256", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return merged.filter("group_size > 1").select("text_sha256", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, salts: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select("doc_id", F.sha2(ascii_lower(F.coalesce("text", F.lit(""))), 256).alias("text_sha256"))
    rows = rows.withColumn("salt", _salt(salts))
    groups = exact_groups(docs, salts).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = rows.join(groups, ["text_sha256", "salt"], "left")
    return found.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, salts: int = 16) -> DataFrame:
    """docs without the copies, all columns as they were; of rows that repeat the kept doc_id and text, each stays.

    A row is dropped by its doc_id and text together: another text under the same doc_id stays.
    """
    key, digest = free_name(docs.columns, "id_"), free_name(docs.columns, "digest_")
    dropped = exact_dedup(docs, salts).filter(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("text_sha256").alias(digest)).distinct()
    same = (F.sha2(ascii_lower(F.coalesce(docs["text"], F.lit(""))), 256) == dropped[digest]) & docs["doc_id"].eqNullSafe(dropped[key])
    return docs.join(dropped, same, "left_anti")
