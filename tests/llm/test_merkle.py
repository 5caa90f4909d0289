"""Merkle manifest against a plain recomputation: roots, proofs, requests, tampering, odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tracemill.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank_ string, tree_ int, digest binary"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def tree(digests):
    paths, own = [[] for _ in digests], [[k] for k in range(len(digests))]
    while len(digests) > 1:
        up, held = [], []
        for a in range(0, len(digests), 8):
            run = digests[a : a + 8]
            for j in range(len(run)):
                for k in own[a + j]:
                    paths[k].append(("".join(run[:j]), "".join(run[j + 1 :])))
            up.append(h(*run))
            held.append([k for x in own[a : a + 8] for k in x])
        digests, own = up, held
    return digests[0], paths


def brute(rows):
    trees, out = {}, []
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    kept = [sorted(trees[x], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[4]))) for x in order]
    grown = [tree([leaf_of(r, r[4]) for r in rs]) for rs in kept]
    root, top = tree([s for s, _ in grown])
    for rs, (sub, paths), above in zip(kept, grown, top):
        for r, path in zip(rs, paths):
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            x = leaf_of(r, r[4].translate(LOW) if bad else r[4])
            for a, b in path + above:
                x = h(a, x, b)
            out.append((r[0], leaf_of(r, r[4]), sub, root, h(*(a + b for a, b in path + above)), x, x == root))
    return sorted(out, key=str)


def rows_of(n, langs, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "Some Text", "lower", "É Ü", "x" * 50_000]
    return [(rng.choice([k, k, k, None, 5]), rng.choice([None, "s", "web"]), rng.choice(langs), rng.choice([None, 3]), rng.choice(texts) if k % 2 else f"Text {k}") for k in range(n)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "r", 1, b"d") for r in rows], SCHEMA).repartition(5)
    return sorted((tuple(r) for r in merkle.verify_documents(df).select(*COLUMNS).collect()), key=str)


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (8, ["en"]), (9, [None]), (70, ["en", None, "é", "", "z"]), (700, ["en"] * 9 + ["de"])])
def test_against_plain_trees(spark, n, langs):
    rows = rows_of(n, langs)
    assert run(spark, rows) == brute(rows)


def test_many_languages_have_a_tree_of_their_own(spark):
    rows = [(k, None, f"l{k % 75}", k, "Some Text") for k in range(150)]
    assert run(spark, rows) == brute(rows)


def test_equal_rows_and_rows_without_ids(spark):
    rows = [(None, "s", "en", 1, "Same")] * 100 + [(7, "s", "en", 1, "Same")] * 30
    got = run(spark, rows)
    assert got == brute(rows) and len(got) == 130


def test_empty_table(spark):
    out = merkle.verify_documents(spark.createDataFrame([], SCHEMA))
    assert out.columns == COLUMNS and out.count() == 0


def test_every_change_of_a_leaf_is_seen(spark):
    rows = [(k, "s", "en", 1, "All lower" if k % 2 else "all lower") for k in range(60)]
    seen = {r[0]: r[6] for r in run(spark, rows)}
    assert seen == {k: not (k % 2 and zlib.crc32(str(k).encode()) % 3 == 0) for k in seen}


def test_requests_get_their_proofs_only(spark):
    rows = rows_of(300, ["en", "de", None], 3) + [(k, None, "one", 1, "t") for k in range(1)]
    df = spark.createDataFrame([(*r, "r", 1, b"d") for r in rows], SCHEMA)
    m, every = merkle.documents_manifest(df)
    asked = m.leaves.filter("rank_ % 17 = 3 or size_ = 1").select("tree_", "rank_")
    some = merkle.prove(m, asked)
    key = lambda d: sorted(tuple(map(str, r)) for r in d.select("tree_", "rank_", "leaf", "path").collect())
    assert key(some) == key(every.join(asked, ["tree_", "rank_"], "left_semi")) and 0 < some.count() < 40
    folded = some.select((merkle.fold(F.col("leaf"), F.col("path")) == m.root).alias("ok")).distinct().collect()
    assert [r["ok"] for r in folded] == [True]
    assert merkle.prove(m, asked.limit(0)).count() == 0


def test_the_store_names_children_by_content(spark):
    m, _ = merkle.documents_manifest(spark.createDataFrame([(*r, "r", 1, b"d") for r in rows_of(200, ["en", "de"], 4)], SCHEMA))
    for records in m.store.values():
        for r in records.collect():
            assert r["digest"] == h(*r["children"]) and 1 <= len(r["children"]) <= 8
