"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir of the session; with a local master a temporary one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tracemill.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.conf.set("tracemill.shared.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again, so that plans do not grow with rounds."""
    path = f"{shared_dir(df.sparkSession)}/tracemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def rows_of(df: DataFrame, most: int = 200_000) -> list:
    """The rows of a table of a model's size; more than ``most`` are an error, as with an activity that is no activity but an id."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a model of over {most} rows: are the activities labels of a bounded alphabet?")
    return found
