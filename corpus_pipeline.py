"""A corpus pipeline of five stages; each works on all that the stage before kept, and its decisions take effect.

quality rules -> exact dedup -> n-gram Jaccard join -> personal data -> best-fit packing. All but the last return
the columns of documents; the last returns the packed pieces.

Defined results, for every stage: an empty table gives an empty one; columns beyond those of documents pass through
(the last stage drops them), whatever their names; doc_id may be null or repeat, rows are judged by what they hold;
very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import dedup, jaccard_join, packing, pii, quality
from tracemill.llm.runtime import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the outlier test reject.

    Null, empty and short texts fail the base rules; repeated rows share their verdict; null lang and source are groups.
    """
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the largest doc_id, of each group of equal texts.

    Null counts as the empty text; a null doc_id stays only if no other is there; rows that repeat the kept doc_id and
    text stay each (the next stage leaves one of them).
    """
    return dedup.drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of linked documents.

    Null and empty texts are linked with nothing and stay; a null doc_id comes last; of rows with one doc_id the first
    read stays.
    """
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; a null text stays null, and where spans overlap the first one's kind is named."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of at most 1024 tokens; a null or empty text is its end token, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Outlier estimates, components and packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
