"""Digests of input files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a file is read as one row.
ROW_BYTES = 512 << 20


def fingerprints(spark: SparkSession, path: str, row_bytes: int | None = None) -> DataFrame:
    """path, length, sha256 of each file; Spark does not list empty ones.

    A file of over ``row_bytes`` is read by ranges, as rows that end with line feeds, whose bytes go through the digest in
    the order of the file; so it may be larger than a row can be, as long as no stretch without a line feed is.
    """
    row_bytes = ROW_BYTES if row_bytes is None else row_bytes
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= row_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    if not files.select("length").filter(F.col("length") > row_bytes).limit(1).count():
        return small

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, done, size = None, None, 0, 0
        found: list[tuple[str, int, str]] = []
        for batch in batches:
            for name, length, line in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "line"))):
                if name != last:
                    found += [(last, size, digest.hexdigest())] if digest else []
                    last, digest, done, size = name, hashlib.sha256(), 0, length
                digest.update(line)
                done += len(line) + 1
                if done <= length:  # the last row has a line feed only if the file ends with one
                    digest.update(b"\n")
        found += [(last, size, digest.hexdigest())] if digest else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))], ["path", "length", "sha256"])

    # as the other source writes the scheme of local files
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/")
    lines = spark.read.text(path, lineSep="\n").select(name.alias("path"), F.col("_metadata.file_size").alias("length"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    lines = lines.filter(F.col("length") > row_bytes).withColumn("at", F.monotonically_increasing_id())
    large = lines.repartition("path").sortWithinPartitions("path", "start", "at").select("path", "length", "line").mapInArrow(digests, "path string, length long, sha256 string")
    return small.unionByName(large)


def mismatches(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files whose digest is not the recorded one; files that were never recorded are fine."""
    return now.join(recorded.select("path", F.col("sha256").alias("recorded")), "path").filter("sha256 <> recorded")
