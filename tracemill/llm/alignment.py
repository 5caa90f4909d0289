"""Alignment of two tokenizers over the same texts: groups of tokens that end together, and the links within them.

Both token lists of a text become dictionaries from cumulative end to index; the keys they share, sorted, cut both lists
into groups, and links are expanded per group. Ends are met window by window (WINDOW bytes), so the dictionaries are
bounded whatever a text's length. Texts are encoded by their parts (pre-tokens for A, words with the blanks before them
for B, since no piece of B holds a blank after anything else, which is checked); each distinct part of a slice is
encoded once.

How many documents hold an id pair linked is counted per block, a run of documents of some megabytes of text, and then
over the corpus. The counts go back by block: a block asks once for each of its distinct pairs, its documents name theirs
by their place among them, and documents meet the answers by block. So what is exchanged is some bytes per document's
pair and a block's distinct pairs, and nothing is broadcast but the highest count of each A id (at most as many rows as A
has ids).

Defined results: null and empty texts, and texts whose joined A or B bytes differ from a blank and the text (those with
U+2581, for one), have no tokens: zeros and an empty digest. Repeated rows and rows without doc_id are documents of their
own. Special tokens' strings are plain text. An empty table gives an empty result; other columns do not matter. Very long
texts are held whole, with their ids; a group whose tokens number m and n has m * n links, which are counted by its
distinct ids.
"""

from __future__ import annotations

import functools
import hashlib
import re
import uuid
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import BLOCK, Vocabulary, blocks, pre_tokens
from .bpe import vocabulary as byte_vocabulary
from .runtime import cut, vocabulary_path
from .text import ragged, strings, text_slices

PIECES = "piece_bpe_32k.model"
#: Bytes of a text whose ends are in dictionaries at a time.
WINDOW = 1 << 16
#: Bytes of text of a block of documents, a longer text alone.
BLOCK_BYTES = 16 << 20
BLANK = "▁"
PART = re.compile(" +[^ ]*")


class Pieces:
    """A sentencepiece model with byte fallback: ids and byte lengths of texts by their words."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(BLANK in n.lstrip(BLANK) for n in names):
            raise ValueError("a piece holds a blank after something else: texts cannot be encoded word by word")
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace(BLANK, " ").encode() for i, n in enumerate(names)]
        self.lengths = np.array(list(map(len, self.bytes)), np.int64)
        self.blank = self.model.piece_to_id(BLANK)

    def parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of parts (each begins with the blank that the model adds) one after another, how many each has, and whether their bytes are the part's."""
        found = [[self.blank] if p == " " else x for p, x in zip(parts, self.model.encode([p[1:] for p in parts], num_threads=1))]
        token = self.bytes
        fine = np.fromiter((b"".join([token[i] for i in x]) == p.encode() for p, x in zip(parts, found)), bool, len(parts))
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.int64, int(n.sum())), n, fine

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of texts that begin with the added blank, one after another, offsets, and whether each text's bytes are those of its tokens."""
        lists = [PART.findall(t) for t in texts]
        coded = pa.array([p for x in lists for p in x], pa.large_string()).dictionary_encode()
        ids, n, fine = self.parts(coded.dictionary.to_pylist())
        which = np.asarray(coded.indices, dtype=np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))])
        per, bad = np.concatenate([[0], np.cumsum(n[which])]), np.concatenate([[0], np.cumsum(~fine[which])])
        return ids[ragged((np.cumsum(n) - n)[which], n[which])], per[bounds], bad[bounds[1:]] == bad[bounds[:-1]]


@functools.cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def pieces_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def encode_plain(texts: list[str], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """A's ids of texts one after another, and offsets; strings of special tokens are plain text."""
    runs, ends = [], [0]
    for some, long in _runs(texts):
        for counts, found in [(None, x) for x in blocks(some[0])] if long else [pre_tokens(some)]:
            coded = found.dictionary_encode()
            flat, lengths = vocab.pieces(coded.dictionary)
            which = np.asarray(coded.indices, dtype=np.int64)
            runs.append(flat[ragged((np.cumsum(lengths) - lengths)[which], lengths[which])].astype(np.int64))
            if not long:
                ends += (ends[-1] + np.concatenate([[0], np.cumsum(lengths[which])])[counts[1:]]).tolist()
        if long:
            ends.append(sum(map(len, runs)))
    return np.concatenate(runs) if runs else np.empty(0, np.int64), np.array(ends, np.int64)


def _runs(texts: list[str]):
    """Runs of short texts, and long ones alone."""
    at = 0
    while at < len(texts):
        end = at
        while end < len(texts) and len(texts[end]) <= BLOCK:
            end += 1
        yield (texts[at:end], False) if end > at else (texts[at : at + 1], True)
        at = max(end, at + 1)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the tokens of both lists whose cumulative ends coincide, in order, by dictionaries from end to index."""
    at_a, at_b, i, j, limit = [], [], 0, 0, WINDOW
    while i < len(a) and j < len(b):
        k, m = np.searchsorted(a, limit, "right"), np.searchsorted(b, limit, "right")
        of_a, of_b = dict(zip(a[i:k].tolist(), count(int(i)))), dict(zip(b[j:m].tolist(), count(int(j))))
        both = sorted(of_a.keys() & of_b.keys())
        at_a += map(of_a.__getitem__, both)
        at_b += map(of_b.__getitem__, both)
        i, j = k, m
        limit = max(limit + WINDOW, int(min(a[i] if i < len(a) else limit, b[j] if j < len(b) else limit)))
    return np.array(at_a, np.int64), np.array(at_b, np.int64)


@functools.cache
def _decimals(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of 0..size-1 one after another: bytes, starts, lengths."""
    names = [str(k).encode() for k in range(size)]
    n = np.fromiter(map(len, names), np.int64, size)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(n) - n, n


def groups_digest(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, step: int = 1 << 16) -> str:
    """SHA-256 of ``a1,a2|b1;a3|b2,b3``: the ids of each group, written some groups at a time."""
    digits, starts, lengths = _decimals(1 << 16)
    digest = hashlib.sha256()
    for g in range(0, len(at_a), step):
        ea, eb = at_a[g : g + step] + 1, at_b[g : g + step] + 1
        fa, fb = (at_a[g - 1] + 1, at_b[g - 1] + 1) if g else (0, 0)
        na, nb = np.diff(np.append(fa, ea)), np.diff(np.append(fb, eb))
        ids = np.concatenate([a[fa : ea[-1]], b[fb : eb[-1]]])
        total, before = na + nb, np.cumsum(na + nb) - na - nb
        place = np.concatenate([ragged(before, na), ragged(before + na, nb)])
        mark = np.full(len(ids), ord(","), np.uint8)
        mark[before + na - 1], mark[before + total - 1] = ord("|"), ord(";")
        line = np.empty(len(ids), np.int64)
        line[place] = ids
        n = lengths[line]
        out = np.empty(int(n.sum()) + len(line), np.uint8)
        stops = np.cumsum(n + 1) - 1
        out[stops] = mark
        out[ragged(stops - n, n)] = digits[ragged(starts[line], n)]
        digest.update(out[: -1 if g + step >= len(at_a) else None].tobytes())
    return digest.hexdigest()


def linked_pairs(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, width: int, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs (a * width + b) of tokens that share a group, and how many links each has; at most about ``most`` links, or one group, are expanded at a time."""
    na, nb = np.diff(np.append(-1, at_a)), np.diff(np.append(-1, at_b))
    fa, fb = at_a + 1 - na, at_b + 1 - nb
    keys, counts = [], []

    def keep(pairs: np.ndarray, n: np.ndarray | None) -> None:
        k, back = np.unique(pairs, return_inverse=True)
        keys.append(k)
        counts.append(np.bincount(back, n, len(k)).astype(np.int64) if n is not None else np.bincount(back, minlength=len(k)))

    big = na * nb > most
    for g in np.flatnonzero(big):  # by its distinct ids, for each id of A
        ia, ca = np.unique(a[fa[g] : fa[g] + na[g]], return_counts=True)
        ib, cb = np.unique(b[fb[g] : fb[g] + nb[g]], return_counts=True)
        for x, c in zip(ia.tolist(), ca.tolist()):
            keys.append(x * width + ib)
            counts.append(c * cb)
    fa, fb, na, nb = (x[~big] for x in (fa, fb, na, nb))
    part = (np.cumsum(na * nb) - 1) // most
    for lo, hi in zip(*(lambda c: (c[:-1], c[1:]))(np.searchsorted(part, np.arange(part[-1] + 2)) if len(part) else np.zeros(1, np.int64))):
        ta = np.repeat(np.arange(hi - lo), na[lo:hi])  # the group of each A token
        left = a[ragged(fa[lo:hi], na[lo:hi])]
        n = nb[lo:hi][ta]
        keep(np.repeat(left, n) * width + b[ragged(fb[lo:hi][ta], n)], None)
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(keys) == 1:
        return keys[0], counts[0]
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, n = flat[order], n[order]
    head = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    return flat[head], np.add.reduceat(n, head)


def packed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest asks for, that width first."""
    kind = np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + x.astype(kind.newbyteorder("<")).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


#: Rows of documents have the first columns, those of blocks pairs and held (how many of the block's documents hold each pair); ``own`` are
#: the steps between the places of a document's pairs in its block's pairs.
ALIGNED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, own binary, links binary, pairs array<long>, held array<long>"


def align_texts(texts: list[str], va: Vocabulary, vb: Pieces) -> tuple[list[tuple], list[np.ndarray], list[np.ndarray]]:
    """Per text: (n_a, n_b, n_groups, n_links, digest), its distinct linked pairs (a * width + b) and the links of each."""
    texts, width, none = [" " + t if t else "" for t in texts], len(vb.bytes), np.empty(0, np.int64)
    (ia, oa), (ib, ob, fine) = encode_plain(texts, va), vb.encode(texts)
    rows, pairs, links = [], [], []
    for k, good in enumerate(fine.tolist()):
        a, b = ia[oa[k] : oa[k + 1]], ib[ob[k] : ob[k + 1]]
        row, p, n = (0, 0, 0, 0, ""), none, none
        if good and len(a):
            at_a, at_b = common_ends(np.cumsum(va.lengths[a]), np.cumsum(vb.lengths[b]))
            p, n = linked_pairs(a, b, at_a, at_b, width)
            row = (len(a), len(b), len(at_a), int(n.sum()), groups_digest(a, b, at_a, at_b))
        rows.append(row)
        pairs.append(p)
        links.append(n)
    return rows, pairs, links


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Rows of documents and of blocks, as ALIGNED says; a block is a run of documents of one task."""
    a_path, b_path = vocabulary_path(a_path), pieces_path(b_path)
    schema = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[t]) for n, t in (c.split() for c in ALIGNED.split(", "))])

    def block(ids: list, rows: list, pairs: list[np.ndarray], links: list[np.ndarray]) -> pa.RecordBatch:
        known, held = np.unique(np.concatenate(pairs), return_counts=True)
        own = [packed(np.diff(np.searchsorted(known, p), prepend=0)) for p in pairs]
        name, n = uuid.uuid4().int >> 65, len(ids) + 1
        tail = [*zip(*rows)] if rows else [()] * 5
        columns = [[name] * n, [*ids, None], *([*x, None] for x in tail), [*own, None], [*map(packed, links), None], [None] * (n - 1) + [known], [None] * (n - 1) + [held]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        va, vb = byte_vocabulary(a_path), pieces(b_path)
        waiting, size = ([], [], [], []), 0
        for batch in batches:
            for part in text_slices(batch, "text"):
                n = part.column("text").nbytes
                if size and size + n > BLOCK_BYTES:
                    yield block(*waiting)
                    waiting, size = ([], [], [], []), 0
                size += n
                found = align_texts(strings(part, "text").to_pylist(), va, vb)
                for held, more in zip(waiting, (part.column("doc_id").to_pylist(), *found)):
                    held += more
        if waiting[0]:
            yield block(*waiting)

    return docs.select("doc_id", "text").mapInArrow(run, ALIGNED)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """pair (a * width + b), n_docs (documents that hold it linked) and best (whether no pair of its A id has more)."""
    held = aligned.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "held")).alias("x"))
    counted = cut(held.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n_docs")), "pair-counts")
    keyed = counted.withColumn("a_", F.expr(f"pair div {width}"))
    most = keyed.groupBy("a_").agg(F.max("n_docs").alias("most_"))  # at most one row per id of A
    return keyed.join(F.broadcast(most), "a_").select("pair", "n_docs", (F.col("n_docs") == F.col("most_")).alias("best"))


SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _sums(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """n_best and count_sum of a block's documents from the block's answers."""
    order = np.argsort(np.asarray(answers.column("at")), kind="stable")
    n, best = (np.asarray(answers.column(c))[order] for c in ("n_docs", "best"))
    n_best, count_sum = [], []
    for own, links in zip(docs.column("own").to_pylist(), docs.column("links").to_pylist()):
        at, m = np.cumsum(unpacked(own)), unpacked(links)
        n_best.append(int(m[best[at]].sum()) if len(at) else 0)
        count_sum.append(int((m * n[at]).sum()) if len(at) else 0)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    return pa.Table.from_arrays([*(docs.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], [*kept, "n_best", "count_sum", "groups_sha256"])


def score(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: tokens, groups, links, the links that are an A id's most frequent ones in the corpus, and the sum of their counts."""
    aligned = cut(align(docs, a_path, b_path), "aligned")
    asked = aligned.filter("pairs is not null").select(F.col("block").alias("of_block"), F.posexplode("pairs").alias("at", "pair"))
    counts = pair_counts(aligned, len(pieces(pieces_path(b_path)).bytes))
    answers = asked.join(counts, "pair").select("of_block", "at", "n_docs", "best")
    rows = aligned.filter("pairs is null").drop("pairs", "held")
    return rows.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(_sums, SCORED)
