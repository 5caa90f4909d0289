"""The pipeline's stages on nulls, empty and long texts, repeated rows, clashing columns and an empty table, against what each stage promises."""

from collections import Counter

import pytest

import corpus_pipeline
from test_operators import make

FINE = [" ".join(f"w{k * 7 + j}" for j in range(90)) for k in range(6)]


@pytest.fixture(scope="module")
def odd(spark):
    near = FINE[0].replace("w3 ", "changed ")
    texts = [*FINE, FINE[1], FINE[1].upper(), near, None, "", " \n", "short", FINE[2] + " mail me at a.b@c.example.com", " ".join(f"x{k}" for k in range(20_000))]
    ids = [0, 1, 2, 3, 4, 5, 1, 7, 8, 9, 10, None, 12, 13, 3]
    return make(spark, texts, ids)


def test_stages(spark, odd, tmp_path):
    docs = odd
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == odd.schema.names, name
        path = f"{tmp_path}/{k}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        left = Counter(r["text"] for r in docs.collect())
        if name == "quality_rules":
            assert None not in left and "short" not in left and left[FINE[1]] == 2
        if name == "exact_dedup":
            assert left[FINE[1]] == 0 and left[FINE[1].upper()] == 1  # the largest doc_id stays
        if name == "near_duplicates":
            assert left[FINE[0]] == 1 and not any("changed" in t for t in left)
        if name == "personal_data":
            assert not any("@" in t for t in left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    used = Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024 and {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.collect()}


def test_stages_on_an_empty_table(spark, odd, tmp_path):
    docs = odd.limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0, name
