"""Every query with SQL gives the rows that DuckDB gives, and the same rows under other partition counts."""

import os

import duckdb
import pandas as pd
import pytest

from tracemill import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(map(cell, r)) for r in df[names].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_duckdb(spark, con, sf, name):
    assert rows(Q.queries()[name](spark, sf).toPandas()) == rows(con.sql(Q.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["a2_variant_table", "d9_bindings", "f9_coverage", "o4_object_centric_dfg", "p5_split_by_time", "w3_global_order"])
def test_partitions_do_not_matter(spark, sf, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(rows(Q.queries()[name](spark, sf).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2]


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_other_queries_give_rows(spark, sf, name):
    assert Q.queries()[name](spark, sf).count() > 0
