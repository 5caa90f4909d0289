"""Alignment of two tokenizers against both libraries: groups, links, counts over the corpus, odd rows."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import pytest

from tracemill.llm import alignment
from tracemill.llm.bpe import byte_letters, vocabulary
from tracemill.llm.runtime import vocabulary_path

SCHEMA = "doc_id long, text string, block string, pair int, links string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.pieces_path())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    words = ["the", "tion", "Überraschung", "2024", "foo_bar", "日本", "x", "international", "<s>", "\n", "  "]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return out + [
        None, "", " ", "  ", " lead", "trail  ", "x▁y", "<|endoftext|> a <s> <unk> <0x41>", "a\tb\n\nc  d", "é" * 50, "\x00z", "日本語テキスト " * 30,
        "a" * 5000, " " * 300, "　 x", "word " * 3000 + "🎉" * 300, out[0], out[0],
    ]


def plain(text, libraries):
    """Counts and digest, and the links of each pair, straight from the definition."""
    none = ((0, 0, 0, 0, ""), Counter())
    if not text:
        return none
    a, b, letters = *libraries, byte_letters()
    full, ia, ib = " " + text, a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ta = [bytes(letters[c] for c in a.id_to_token(i)) for i in ia]
    tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
    if b"".join(ta) != full.encode() or b"".join(tb) != full.encode():
        return none
    ea, eb = list(accumulate(map(len, ta))), list(accumulate(map(len, tb)))
    groups, links, i, j = [], Counter(), 0, 0
    for end in sorted(set(ea) & set(eb)):
        k, m = ea.index(end) + 1, eb.index(end) + 1
        groups.append((ia[i:k], ib[j:m]))
        links.update((x, y) for x in ia[i:k] for y in ib[j:m])
        i, j = k, m
    written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return (len(ia), len(ib), len(groups), links.total(), hashlib.sha256(written.encode()).hexdigest()), links


def corpus(rows, libraries):
    found = [(doc_id, *plain(t, libraries)) for doc_id, t in rows]
    docs = Counter(p for *_, links in found for p in links)
    most = Counter()
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    return sorted(
        ((d, *row[:4], sum(n for p, n in links.items() if docs[p] == most[p[0]]), sum(n * docs[p] for p, n in links.items()), row[4]) for d, row, links in found), key=str
    )


@pytest.mark.parametrize("window,most", [(alignment.WINDOW, 1 << 20), (3, 4)])
def test_groups_and_links(texts, libraries, window, most, monkeypatch):
    monkeypatch.setattr(alignment, "WINDOW", window)
    monkeypatch.setattr(alignment.linked_pairs, "__defaults__", (most,))
    monkeypatch.setattr(alignment.groups_digest, "__defaults__", (max(1, most // 2),))
    va, vb = vocabulary(vocabulary_path()), alignment.pieces(alignment.pieces_path())
    for text, row, pairs, links in zip(texts, *alignment.align_texts([t or "" for t in texts], va, vb)):
        want, counted = plain(text, libraries)
        assert row == want, text
        assert {divmod(int(p), len(vb.bytes)): int(n) for p, n in zip(pairs, links)} == counted, text


def test_groups_of_any_form():
    """Lists whose ends seldom meet: groups of many tokens on both sides."""
    rng = np.random.default_rng(2)
    for most in (1, 5, 1 << 20):
        for _ in range(50):
            ea = np.unique(np.append(rng.integers(1, 60, 12), 60))
            eb = np.unique(np.append(rng.integers(1, 60, 12), 60))
            a, b = rng.integers(0, 4, len(ea)), rng.integers(0, 3, len(eb))
            at_a, at_b = alignment.common_ends(ea, eb)
            both = sorted(set(ea.tolist()) & set(eb.tolist()))
            assert ea[at_a].tolist() == eb[at_b].tolist() == both
            want, low = Counter(), 0
            for end in both:
                want.update((int(x), int(y)) for x in a[(ea > low) & (ea <= end)] for y in b[(eb > low) & (eb <= end)])
                low = end
            pairs, links = alignment.linked_pairs(a, b, at_a, at_b, 10, most)
            assert dict(zip(map(lambda p: divmod(int(p), 10), pairs), links.tolist())) == want


def test_texts_in_blocks(texts, libraries, monkeypatch):
    from tracemill.llm import bpe

    for size in (7, 100):
        monkeypatch.setattr(alignment, "BLOCK", size)
        monkeypatch.setattr(bpe.blocks, "__defaults__", (size,))
        full = [" " + t if t else "" for t in texts]
        ids, ends = alignment.encode_plain(full, vocabulary(vocabulary_path()))
        for t, a, b in zip(full, ends[:-1], ends[1:]):
            assert ids[a:b].tolist() == (libraries[0].encode(t, add_special_tokens=False).ids if t else []), t


def test_packed_numbers():
    for x in ([], [0], [255], [256, 1], [70_000, 0], [1 << 40]):
        assert alignment.unpacked(alignment.packed(np.array(x, np.int64))).tolist() == x


@pytest.mark.parametrize("block_bytes", [1, 4096, alignment.BLOCK_BYTES])
def test_counts_over_the_corpus(spark, texts, libraries, block_bytes, monkeypatch):
    rows = [(k if k % 5 else None, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    df = spark.createDataFrame([(d, t, "b", 1, "l") for d, t in rows], SCHEMA).repartition(3)
    assert sorted((tuple(r) for r in alignment.score(df).select(*COLUMNS).collect()), key=str) == corpus(rows, libraries)


def test_empty_tables(spark):
    assert alignment.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only = alignment.score(spark.createDataFrame([(1, None, "b", 1, "l"), (2, "", "b", 1, "l")], SCHEMA)).select(*COLUMNS).collect()
    assert sorted(map(tuple, only)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_query_against_the_definition(spark, sf, libraries):
    from tracemill.llm.queries import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in queries()["op13_alignment"](spark, sf).select(*COLUMNS).collect()), key=str) == corpus(rows, libraries)
