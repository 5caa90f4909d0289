"""Intermediate tables, as the rest of the library writes them, and small column helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut


A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VOCABULARY = "byte_bpe_50k.json"


def free_name(columns: list[str], name: str) -> str:
    """A column name that is not among ``columns``, whatever the case of its letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a unique row number as ``name``, written as a table, so that every job sees the same numbers.

    Rows are told apart by it where doc_id is null or repeated.
    """
    return cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows")


def ascii_lower(col):
    """Lower-case A-Z only.

    lower() does that for texts of one byte per character; others go through translate(), which leaves
    letters beyond A-Z alone.
    """
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(F.translate(col, A_TO_Z, A_TO_Z.lower()))


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: a path, or by default the public byte-level one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def look_up(rows: DataFrame, table: DataFrame, key: str | list[str], how: str = "inner", most: int = 20_000, salts: int = 16) -> DataFrame:
    """rows joined with a table that has one row per key, whatever share of the rows one key holds.

    A table of at most ``most`` rows is broadcast; a larger one is repeated over ``salts`` salts, and the rows of
    each key are dealt over them.
    """
    if table.limit(most + 1).count() <= most:
        return rows.join(F.broadcast(table), key, how)
    salted = rows.withColumn("salt_", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    keys = [key] if isinstance(key, str) else key
    return salted.join(table.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*keys, "salt_"], how).drop("salt_")


def bounded_sample(df: DataFrame, key: list, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows (all, if there are not many more), those with the smallest hashes of ``key``.

    The share of hashes that is kept follows from the number of rows, so no task holds or sends more than its part.
    """
    n, grid = df.count(), 1 << 30
    if n <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(grid)) < int(grid * rows / n))
