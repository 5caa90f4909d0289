"""Quality rules: text statistics per document and robust multivariate outliers per language and source.

The statistics are transformed into vectors; a minimum-covariance-determinant estimate is fitted for each
(lang, source). As in the fast algorithm for it, many small random subsets of a bounded sample of each group are
concentrated first, and the few of least determinant are where the concentration steps over all rows start: distances
under the present estimate, their quantile per group, then mean and covariance of the rows within it, rescaled for
their share of a normal distribution. Steps go on until no determinant falls any more, and each group takes its
estimate of least determinant. Every step is a grouped aggregation of a small table, so a group that holds a third of
all rows costs no task more than another. Documents whose squared Mahalanobis distance exceeds the cutoff (by default
the chi-square quantile at CONFIDENCE for the entries of the vector) are rejected.

Defined results: null text counts as empty; a text without words fails the base rules; null lang or source form
groups of their own; groups with fewer than ``least`` documents that pass the base rules use the estimate over all
groups; repeated rows and rows with one doc_id are judged each; a very long text is counted whole, alone in its slice;
of estimates with one determinant the first started is taken; an empty table gives an empty result; other columns do
not matter.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut, free_name, look_up
from .text import by_slice, strings, words_of

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: The vector: mean word length, symbols, repeated lines and repeated words as rates, each on a logarithmic scale.
VECTOR = ("v_length", "v_symbols", "v_lines", "v_repeats")
#: Least standard deviation of each entry: most documents have no symbol and no repeated line at all. At the default
#: cutoff one entry alone rejects from about 12 symbols in 1000 characters, or a fifth of the lines or words repeated.
FLOORS = (0.06, 0.6, 0.7, 0.7)
CONFIDENCE = 0.999
#: Rows of a group in which starts are looked for, random subsets of it, starts taken further over all rows, most steps
#: there, and the fall of the log determinant that ends them.
SAMPLE, SUBSETS, STARTS, STEPS, FALL = 1500, 50, 3, 12, 1e-3


def chi_square(x: float, degrees: int) -> float:
    """Share of the chi-square distribution up to x, for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))


def chi_square_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < share else (low, middle)
    return high


def consistency(fraction: float, degrees: int) -> float:
    """What the covariance of the nearest ``fraction`` of normal rows has to be multiplied by."""
    return fraction / chi_square(chi_square_quantile(fraction, degrees), degrees + 2) if fraction < 1 else 1.0


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text of a large-string array."""
    n = len(texts)
    offsets, codes, distinct = words_of(texts, lower=False)
    n_words = np.diff(offsets)
    owner = np.repeat(np.arange(n), n_words)
    chars = np.asarray(pc.utf8_length(distinct), dtype=np.int64)[codes] if len(codes) else codes
    word_chars = np.bincount(owner, chars, n).astype(np.int64)
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[begins[0] : begins[-1]] if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    table = np.zeros(256, bool)
    table[np.frombuffer(SYMBOLS.encode(), np.uint8)] = True
    total = np.concatenate([[0], np.cumsum(table[data])])
    n_symbols = np.diff(total[begins - begins[0]])
    lines = pc.split_pattern(texts, "\n")
    line_codes = lines.flatten().dictionary_encode()
    line_owner = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets, dtype=np.int64)))
    has_word = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(line_codes.dictionary))) > 0
    which = np.asarray(line_codes.indices, dtype=np.int64)
    kept = has_word[which] if len(which) else np.zeros(0, bool)
    n_lines = np.bincount(line_owner[kept], minlength=n)
    different = np.unique(line_owner[kept] * (len(has_word) + 1) + which[kept])
    n_dup_lines = n_lines - np.bincount(different // (len(has_word) + 1), minlength=n)
    repeated = np.zeros(len(codes), bool)
    if len(codes) >= 3:
        k = len(distinct) + 1
        windows = np.flatnonzero(owner[2:] == owner[:-2])
        pair = codes[windows] * k + codes[windows + 1]
        if k > 2_000_000:  # three codes would not fit in 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        gram = pair * k + codes[windows + 2]
        order = np.lexsort((gram, owner[windows]))
        g, o = gram[order], owner[windows][order]
        same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(len(g), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = windows[order[twice]]
        for shift in range(3):
            repeated[at + shift] = True
    n_repeat = np.bincount(owner[repeated], minlength=n)
    return dict(zip(COUNTS, (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, n_lines)))


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def document_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, text_hash and COUNTS per document."""

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        found = count_texts(strings(part, "text"))
        keys = [part.column(c) for c in ("doc_id", "lang", "source", "text_hash")]
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(found[c].astype(np.int64)) for c in COUNTS)], ["doc_id", "lang", "source", "text_hash", *COUNTS])

    rows = docs.select("doc_id", "lang", "source", _text_hash(F.col("text")).alias("text_hash"), "text")
    return rows.mapInArrow(by_slice("text", each), "doc_id long, lang string, source string, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS))


def with_vectors(counts: DataFrame) -> DataFrame:
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "v_length": F.log(chars / words),
        "v_symbols": F.log1p(1000 * F.col("n_symbols") / chars),
        "v_lines": F.log1p(100 * F.greatest(F.col("n_dup_lines") - 1, F.lit(0)) / F.greatest("n_lines", F.lit(1))),  # one may repeat: in a short text its rate says little
        "v_repeats": F.log1p(100 * F.col("n_repeat_words") / words),
    })


def _distance(center: str = "center", precision: str = "precision") -> Column:
    d = len(VECTOR)
    diff = [F.col(v) - F.col(center)[i] for i, v in enumerate(VECTOR)]
    return sum((diff[i] * diff[j] * F.col(precision)[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))


def regular(mean: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Center, precision matrix and log determinant, with deviations of FLOORS at least and correlations that leave each direction a tenth."""
    scale = np.maximum(np.sqrt(np.maximum(np.diag(cov), 0)), FLOORS)
    cov = cov.copy()
    np.fill_diagonal(cov, scale**2)
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    values = np.maximum(values, 0.1)
    inverse = vectors @ np.diag(1 / values) @ vectors.T / np.outer(scale, scale)
    return mean, inverse, float(np.log(values).sum() + 2 * np.log(scale).sum())


def concentrate(x: np.ndarray, center: np.ndarray, precision: np.ndarray, fraction: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One concentration step on the rows of x: the estimate from the nearest ``fraction`` of them."""
    diff = x - center
    distance = np.einsum("ij,jk,ik->i", diff, precision, diff)
    near = x[np.argsort(distance, kind="stable")[: max(1, math.ceil(fraction * len(x)))]]
    return regular(near.mean(axis=0), consistency(fraction, x.shape[1]) * np.cov(near.T, bias=True).reshape(x.shape[1], -1))


def best_starts(x: np.ndarray, fraction: float, subsets: int = SUBSETS, keep: int = STARTS) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """The estimates of least determinant that steps from the coordinates' medians and from random subsets of x lead to."""
    rng, d = np.random.default_rng(0), x.shape[1]
    found = [regular(np.median(x, axis=0), np.diag((np.subtract(*np.percentile(x, [75, 25], axis=0)) / 1.349) ** 2))]
    for _ in range(subsets):
        part = x[rng.choice(len(x), min(len(x), d + 1), replace=False)]
        found.append(regular(part.mean(axis=0), np.cov(part.T, bias=True).reshape(d, d)))
    found = [concentrate(x, *concentrate(x, c, p, fraction)[:2], fraction) for c, p, _ in found]
    out: list[tuple[np.ndarray, np.ndarray, float]] = []
    for one in sorted(found, key=lambda e: e[2])[: 4 * keep]:
        for _ in range(20):
            before, one = one, concentrate(x, *one[:2], fraction)
            if before[2] - one[2] < 1e-6:
                break
        if all(abs(one[2] - o[2]) > 1e-4 for o in out):
            out.append(one)
    return sorted(out, key=lambda e: e[2])[:keep]


ESTIMATE = "grp string, start int, center array<double>, precision array<double>, log_det double"


def _starts(rows: DataFrame, sizes: DataFrame, fraction: float) -> DataFrame:
    """Up to STARTS estimates of each group, from about SAMPLE of its rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        found = best_starts(pdf.sort_values(list(VECTOR))[list(VECTOR)].to_numpy(float), fraction)
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "start": range(len(found)), "center": [c.tolist() for c, _, _ in found], "precision": [p.ravel().tolist() for _, p, _ in found], "log_det": [x for _, _, x in found]})

    grid = 1 << 30
    share = F.pmod(F.xxhash64("rid", F.lit(9)), F.lit(grid)) < F.ceil(F.lit(float(grid * SAMPLE)) / F.col("n"))
    return look_up(rows, sizes, "grp").filter(share).select("grp", *VECTOR).groupBy("grp").applyInPandas(one, ESTIMATE)


def _estimates(moments: DataFrame, rescale: float) -> DataFrame:
    """Estimate of each group and start from its count, sums and sums of products."""
    d = len(VECTOR)

    def run(frames):
        for pdf in frames:
            found = []
            for r in pdf.itertuples(index=False):
                mean = np.array([getattr(r, f"s{i}") for i in range(d)]) / r.n
                second = np.empty((d, d))
                for i in range(d):
                    for j in range(i, d):
                        second[i, j] = second[j, i] = getattr(r, f"p{i}_{j}") / r.n
                found.append(regular(mean, rescale * (second - np.outer(mean, mean))))
            yield pd.DataFrame({"grp": pdf["grp"], "start": pdf["start"], "center": [c.tolist() for c, _, _ in found], "precision": [p.ravel().tolist() for _, p, _ in found], "log_det": [x for _, _, x in found]})

    return moments.mapInPandas(run, ESTIMATE)


def fit_mcd(rows: DataFrame, fraction: float = 0.75, steps: int = STEPS, least: int = 50) -> DataFrame:
    """grp, center, precision of each group of ``rows`` (rid, grp and VECTOR), and of group '*' over all rows.

    Groups of fewer than ``least`` rows are left out.
    """
    d = len(VECTOR)
    rows = cut(rows.select("rid", "grp", *VECTOR).withColumn("grp", F.explode(F.array("grp", F.lit("*")))), "vectors")
    sizes = cut(rows.groupBy("grp").agg(F.count("*").alias("n")).filter((F.col("n") >= least) | (F.col("grp") == "*")), "mcd-sizes")
    params = cut(_starts(rows, sizes, fraction), "mcd")
    rows = rows.drop("rid")
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(VECTOR)]
    products = [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    before = None
    for _ in range(steps):
        near = look_up(rows, params.drop("log_det"), "grp").withColumn("distance", _distance())
        limit = near.groupBy("grp", "start").agg(F.percentile_approx("distance", fraction, 10_000).alias("most"))
        with_limit = cut(params.join(limit, ["grp", "start"]).drop("log_det"), "mcd-limit")
        inside = look_up(rows, with_limit, "grp").filter(_distance() <= F.col("most"))
        params = cut(_estimates(inside.groupBy("grp", "start").agg(F.count("*").alias("n"), *sums, *products), consistency(fraction, d)), "mcd")
        if before is not None:
            fall = before.join(params, ["grp", "start"]).agg(F.max(before["log_det"] - params["log_det"])).first()[0]
            if fall is None or fall < FALL:
                break
        before = params
    return params.groupBy("grp").agg(F.min_by(F.struct("center", "precision"), F.struct(F.round("log_det", 9), "start")).alias("e")).select("grp", "e.center", "e.precision")


def judge(docs: DataFrame, cutoff: float | None = None, fraction: float = 0.75, steps: int = STEPS, least: int = 50, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, n_words, the base counts, base_failed, distance and kept; and the columns ``keep`` of lang, source, text_hash."""
    cutoff = chi_square_quantile(CONFIDENCE, len(VECTOR)) if cutoff is None else cutoff
    counts = cut(document_counts(docs).withColumn("rid", F.monotonically_increasing_id()), "counts")
    rows = with_vectors(counts).withColumn("grp", F.concat_ws("\x1f", F.coalesce("lang", F.lit("\x1e")), F.coalesce("source", F.lit("\x1e"))))
    params = fit_mcd(rows.filter("not base_failed"), fraction, steps, least)
    own = params.filter("grp <> '*'").select("grp", F.col("center").alias("own_center"), F.col("precision").alias("own_precision"))
    every = params.filter("grp = '*'").select(F.col("center").alias("all_center"), F.col("precision").alias("all_precision"))
    found = look_up(rows, own, "grp", "left").join(F.broadcast(every), how="left")  # one row
    found = found.withColumns({"center": F.coalesce("own_center", "all_center"), "precision": F.coalesce("own_precision", "all_precision")})
    found = found.withColumn("distance", _distance())
    return found.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"), "distance", *keep)


def keep_good(docs: DataFrame, **settings) -> DataFrame:
    """docs without the rejected documents, all columns as they were.

    A verdict follows from text, lang and source, so rows are dropped by these and doc_id: another text under the same
    doc_id is judged by itself.
    """
    names = [free_name(docs.columns, f"{c}_") for c in ("doc_id", "lang", "source", "text")]
    bad = judge(docs, keep=("lang", "source", "text_hash"), **settings).filter("not kept")
    bad = bad.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "lang", "source", "text_hash"), names))).distinct()
    same = _text_hash(docs["text"]) == bad[names[3]]
    for c, n in zip(("doc_id", "lang", "source"), names):
        same = same & docs[c].eqNullSafe(bad[n])
    return docs.join(bad, same, "left_anti")
