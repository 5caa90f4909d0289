"""Byte-pair encoding by prefix tables against the rank files' library: ids, appends, edits, odd rows."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracemill.llm import prefix_bpe

SCHEMA = "doc_id long, text string, last string, ends long, start long"
PARTS = ["a", "b", " ", "  ", "'s", "'", "\n", "é", "日", "1", "!!", "the ", "aaaaaa", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(prefix_bpe.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return prefix_bpe.ranks(prefix_bpe.ranks_path())


def odd(rng):
    return [
        None, "", " ", "   \n\t x", "trail  ", "<|endoftext|> a", "it's we'll 'tis '", "é" * 50, "\x00z", "日本語テキスト " * 30, "a" * 5000, "　 x",
        "word " * 3000 + "🎉" * 500, "".join(rng.choice(PARTS) for _ in range(3000)), "x" * 100 + "aaaaaaaa" * 600, "same", "same",
    ]


def test_every_character_beside_others(ranks, library):
    characters = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(characters), 20_000):
        text = "".join(f"a{c}1{c}! {c}  {c}{c}\n" for c in characters[at : at + 20_000])
        assert prefix_bpe.encode_texts([text], ranks)[0].tolist() == library.encode_ordinary(text), hex(at)


@pytest.mark.parametrize("long", [3, prefix_bpe.LONG])
def test_ids_are_the_librarys(ranks, library, long, monkeypatch):
    monkeypatch.setattr(prefix_bpe, "LONG", long)
    texts = [t or "" for t in odd(random.Random(1))]
    assert [x.tolist() for x in prefix_bpe.encode_texts(texts, ranks)] == [library.encode_ordinary(t) for t in texts]


def test_texts_in_blocks(ranks, library, monkeypatch):
    from tracemill.llm import bpe

    for size in (7, 64, 1000):
        monkeypatch.setattr(prefix_bpe, "BLOCK", size)
        monkeypatch.setattr(bpe.blocks, "__defaults__", (size,))
        texts = [t or "" for t in odd(random.Random(size))]
        assert [x.tolist() for x in prefix_bpe.encode_texts(texts, ranks)] == [library.encode_ordinary(t) for t in texts]


def test_each_prefix_has_its_last_token(ranks, library):
    piece = "internationalisation"
    table = prefix_bpe.Encoded(ranks, piece).last
    assert list(table) == [library.encode_ordinary(piece[:k])[-1] for k in range(1, len(piece) + 1)]


def test_whole_tokens_that_no_merge_makes(tmp_path):
    """A pre-token that is a token has its id even where merges go another way; as a part of others it does not count."""
    import public_tokenizers
    import tiktoken

    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"ab", b"abc", b"cc"]
    tokens = [t for t in tokens if t != b"abc"] + [b"abcd", b"cd"]  # abcd: bc first leaves a, bc, d, which do not merge
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    v = prefix_bpe.Ranks(str(path))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert set(v.whole) == {b"abcd"}
    rng = random.Random(2)
    for text in ["abcd", "abcd abcd", "abcde", "xabcd"] + ["".join(rng.choice("abcd ") for _ in range(30)) for _ in range(200)]:
        assert prefix_bpe.encode_texts([text], v)[0].tolist() == library.encode_ordinary(text) == prefix_bpe.Encoded(v, text).ids(), text


def test_ties_of_ranks(tmp_path):
    """Different pairs that make one token have one rank: the leftmost goes first."""
    import public_tokenizers
    import tiktoken

    tokens = [bytes([b]) for b in range(256)] + [b"aa", b"aaa", b"ba", b"aab", b"aaaa", b"baa"]
    path = tmp_path / "r.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    v = prefix_bpe.Ranks(str(path))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(3)
    for n in range(400):
        text = "".join(rng.choice("aaab") for _ in range(n % 40))
        assert prefix_bpe.encode_texts([text], v)[0].tolist() == library.encode_ordinary(text) == prefix_bpe.Encoded(v, text).ids(), text


def test_edits_and_appends(ranks, library):
    rng = random.Random(4)
    for _ in range(150):
        e = prefix_bpe.Encoded(ranks, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 60))))
        for step in range(6):
            a = rng.randint(0, len(e.text))
            b = min(len(e.text), a + rng.choice([0, 0, 1, 3, 10]))
            a = b = len(e.text) if step == 5 else b
            e.replace(min(a, b), b, "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 5]))))
            whole = prefix_bpe.Encoded(ranks, e.text)
            assert e.ids() == library.encode_ordinary(e.text), e.text
            assert (e.data, e.last, e.ends, e.stops) == (whole.data, whole.last, whole.ends, whole.stops), e.text


def test_edits_touch_only_what_is_near(ranks, library):
    rng = random.Random(5)
    e = prefix_bpe.Encoded(ranks, "".join(rng.choice("abcdefgh") for _ in range(30_000)))  # one pre-token
    for start, stop, new in ((15_000, 15_001, "XYZ"), (15_000, 15_003, ""), (0, 0, "q"), (30_001, 30_001, "tail")):
        e.replace(start, stop, new)
        assert e.ids() == library.encode_ordinary(e.text) and e.made <= 3 * ranks.lookahead, (start, e.made)
    words = prefix_bpe.Encoded(ranks, "some words in a row " * 3000)
    words.replace(30_000, 30_004, "other")
    assert words.made < 100 and words.ids() == library.encode_ordinary(words.text)


def test_round_trip_of_rows(spark, library):
    texts = odd(random.Random(6))
    rows = [(k if k % 4 else None, t, "x", 3, 4) for k, t in enumerate(texts)]
    got = {tuple(r) for r in prefix_bpe.round_trip(spark.createDataFrame(rows * 2, SCHEMA)).collect()}
    want = set()
    for k, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        want.add((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == want
    assert prefix_bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tables_edits_and_decoding_as_rows(spark, library):
    texts = [t or "" for t in odd(random.Random(7))]
    docs = spark.createDataFrame([(k, t or None, "x", 3, 4) for k, t in enumerate(texts)], SCHEMA)
    edits = spark.createDataFrame([(k, len(t) // 2, len(t) // 2 + 2, "'ll go") for k, t in enumerate(texts) if k % 3], "doc_id long, start long, stop long, new string")
    appended = spark.createDataFrame([(k, 1 << 40, 1 << 40, " end") for k in range(len(texts))], "doc_id long, start long, stop long, new string")
    once = prefix_bpe.edit(prefix_bpe.prefix_tables(docs), edits)
    got = {r["doc_id"]: r for r in prefix_bpe.edit(once.select("doc_id", "text", "last", "ends"), appended).collect()}
    for k, t in enumerate(texts):
        want = (t[: len(t) // 2] + "'ll go" + t[len(t) // 2 + 2 :] if k % 3 else t) + " end"
        assert (got[k]["text"], got[k]["ids"]) == (want, library.encode_ordinary(want)), k
    back = {r["doc_id"]: r["text"] for r in prefix_bpe.decode_documents(prefix_bpe.encode_documents(docs)).collect()}
    assert back == dict(enumerate(texts))


def test_query_runs_over_all_documents(spark, sf):
    from tracemill.llm.queries import queries

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = queries()["op11_prefix_bpe"](spark, sf)
    lost = docs.join(out.filter(F.col("n_tokens") > 0), "doc_id", "left_anti").filter(F.length("text") > 0)
    assert out.count() == docs.count() and lost.count() == 0
