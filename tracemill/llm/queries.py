"""The registered queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, dedup, jaccard_join, lm, merkle, packing, pii, prefix_bpe, quality, sharding, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.convert_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_documents(spark, sf_dir))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(_documents(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_documents(spark, sf_dir))


def op11_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_bpe.round_trip(_documents(spark, sf_dir))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_documents(_documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.score(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_jaccard_join, op3_warc, op4_bpe, op5_lm, op6_packing, op7_exact_dedup, op8_sharding, op9_quality, op10_pii, op11_prefix_bpe, op12_merkle, op13_alignment)}


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

OP3_SQL = """
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY hex) AS first_id,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM q
"""

OP7_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM t WINDOW g AS (PARTITION BY t)
"""


def op12_sql(levels: int = 10) -> str:
    """Trees of up to 8 ** levels leaves, level by level; then each leaf climbs, with its proof and what it folds to."""
    field = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    # crc32 of the decimal digits, bit by bit
    crc = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384)))) % 3 = 0"""
    out = [
        f"l AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} THEN {leaf(lower)} ELSE {leaf('text')} END AS shown FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l)",
        "n0 AS (SELECT tree, i, n, leaf AS d FROM a0)",
    ]

    def grow(nodes: str, tops: str) -> None:
        for k in range(1, levels + 1):
            out.append(f"{nodes}{k} AS (SELECT tree, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {nodes}{k - 1} WHERE n > 1 GROUP BY ALL)")
        out.append(f"{tops} AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {nodes}{k} WHERE n = 1" for k in range(levels + 1)) + ")")

    def climb(rows: str, nodes: str, tree: str) -> None:
        for k in range(levels):
            out.append(f"""{rows}{k + 1} AS (SELECT p.* EXCLUDE (i, proof, f), p.i // 8 AS i, p.proof || coalesce(x.lefts, '') || coalesce(x.rights, '') AS proof,
  CASE WHEN x.n > 1 THEN sha256(x.lefts || p.f || x.rights) ELSE p.f END AS f FROM {rows}{k} p LEFT JOIN (
  SELECT a.tree, a.i, any_value(a.n) AS n, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lefts, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rights
  FROM {nodes}{k} a JOIN {nodes}{k} b ON a.tree = b.tree AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.tree, a.i) x ON x.tree = p.{tree} AND x.i = p.i)""")

    grow("n", "s")
    out.append("t0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, d, tree AS lang FROM s)")
    out.append("o AS (SELECT i AS place, lang AS tree, d AS subroot FROM t0)")
    grow("t", "r")
    out.append("p0 AS (SELECT row_number() OVER () AS k, doc_id, tree, leaf, shown, i, '' AS proof, shown AS f FROM a0)")
    climb("p", "n", "tree")
    out.append(f"q0 AS (SELECT p.* EXCLUDE (i), place AS i, subroot, '' AS top FROM p{levels} p JOIN o USING (tree))")
    climb("q", "t", "top")
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM q{levels}, r"


def oracle_sql() -> dict[str, str]:
    return {"op2_jaccard_join": OP2_SQL, "op3_warc": OP3_SQL, "op7_exact_dedup": OP7_SQL, "op12_merkle": op12_sql()}
