"""Byte-level BPE by ranks as dynamic programming over prefixes: each byte prefix of a pre-token has one valid last token.

The token that ends the encoding of a prefix is the one token ending there that can stand behind the last token of the
prefix before it; so a table of last tokens holds the encodings of all prefixes, and a walk back from the end reads one
off. Two things follow. Appending is exact: old entries stay. And after an edit only entries near it are made again:
an entry depends on the bytes and entries of the longest token's length before it, so once as many entries in a row are
what they were, all later ones are. ``Encoded`` does both for a whole text, whose pre-tokens are cut again from a little before
the edit until a border falls on an old one.

The main path makes the tables of all distinct pre-tokens of a slice in step, with array operations.

Defined results: null and empty texts have no tokens; special tokens do not exist, their strings are plain text; a
pre-token that is a token by itself has that one id, as the rank files' library does, whatever its merges would give; of
merges of one rank the leftmost goes first; repeated rows are encoded each; very long texts are encoded whole, in blocks
whose ids are hashed as they come (the text itself is held); an empty table gives an empty result; other columns do not
matter; an edit of a null text is one of an empty text.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from array import array
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BLOCK, Vocabulary, blocks, pre_tokens
from .text import by_slice, ragged, strings

RANKS = "byte_bpe_50k.tiktoken"
#: Pre-tokens of more bytes get their table one by one.
LONG = 4096
#: Characters behind a pre-token's end that can decide where it ends: a contraction's letters, or the end of white space.
SEEN = 4


class Ranks(Vocabulary):
    """A rank file: two parts merge if together they are a token, whose rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        pairs = {(t[:k], t[k:]): i for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
        self.hold(ids, pairs, {})
        #: Tokens that merges never make: they are found only as whole pre-tokens.
        self.whole = {t: i for t, i in ids.items() if len(t) > 1 and self.rank[i] > i}

    def merge(self, piece: bytes) -> list[bytes]:
        """Merge by rank, one pair at a time, the leftmost of the lowest rank."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    @functools.cached_property
    def backwards(self) -> tuple[dict[int, int], list[bytes | None]]:
        """A tree of the tokens' bytes from their last one on: next node by node and byte, and the token of each node."""
        steps, tokens = {}, [None]
        for token in self.ids:
            if token in self.whole:
                continue
            node = 0
            for byte in reversed(token):
                key = node << 8 | byte
                if key not in steps:
                    steps[key] = len(tokens)
                    tokens.append(None)
                node = steps[key]
            tokens[node] = token
        return steps, tokens

    def last_token(self, data: bytearray, begin: int, at: int, last) -> int:
        """The last token of the prefix data[begin:at], from the entries of the prefixes before it (last[p - 1] is that of the prefix ending at p)."""
        steps, tokens = self.backwards
        node, p = 0, at
        while p > begin:
            p -= 1
            node = steps.get(node << 8 | data[p], 0)
            if not node:
                break
            token = tokens[node]
            if token is not None and (p == begin or self.follows(self.token_bytes[last[p - 1]], token)):
                return self.ids[token]
        raise ValueError("the rank file lacks single bytes")

    def read_off(self, data: bytearray, begin: int, end: int, last) -> list[int]:
        """The ids of the pre-token data[begin:end]."""
        if end - begin <= self.lookahead and (i := self.ids.get(bytes(data[begin:end]))) is not None:
            return [i]
        out = []
        while end > begin:
            out.append(last[end - 1])
            end -= len(self.token_bytes[out[-1]])
        return out[::-1]

    def pieces(self, pieces: pa.Array, in_step: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and how many each has, read off their tables."""
        if not len(pieces):
            return np.empty(0, np.uint32), np.zeros(0, np.int64)
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data, lengths = np.frombuffer(pieces.buffers()[2], np.uint8), np.diff(offsets)
        short = lengths <= LONG
        starts, sizes = offsets[:-1][short], lengths[short]
        last, ends = self.last_tokens(data, starts, sizes), np.cumsum(sizes)
        if self.whole:
            for k, piece in enumerate(pieces.filter(pa.array(short)).to_pylist()):
                last[ends[k]] = self.whole.get(piece, last[ends[k]])
        ids, n = self.walk_back(last, sizes)
        if short.all():
            return ids, n
        counts = np.zeros(len(pieces), np.int64)
        counts[short] = n
        long = {int(k): self.encode_piece(data[offsets[k] : offsets[k + 1]].tobytes()) for k in np.flatnonzero(~short)}
        for k, x in long.items():
            counts[k] = len(x)
        begins = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        out[ragged(begins[short], n)] = ids
        for k, x in long.items():
            out[begins[k] : begins[k] + len(x)] = x
        return out, counts

    def encode_piece(self, piece: bytes) -> list[int]:
        data, last = bytearray(piece), array("i")
        for at in range(1, len(data) + 1):
            last.append(self.last_token(data, 0, at, last))
        return self.read_off(data, 0, len(data), last)


class Encoded:
    """A text with its pre-tokens' ends (in characters and in bytes) and the last token of every byte prefix of each."""

    def __init__(self, ranks: Ranks, text: str = ""):
        self.ranks, self.text, self.data, self.last, self.ends, self.stops = ranks, "", bytearray(), array("i"), [], []
        #: Entries of the table made by the last change.
        self.made = 0
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` in the place of the characters start to stop; only pre-tokens and entries near them are made again."""
        # pre-tokens whose ends do not see the edit stay
        keep = bisect_left(self.ends, start - SEEN + 1)
        c0, b0 = (self.ends[keep - 1], self.stops[keep - 1]) if keep else (0, 0)
        text = self.text[:start] + new + self.text[stop:]
        shift, k = len(new) - (stop - start), bisect_left(self.ends, stop)
        cuts, old = [], len(self.ends)  # ends of new pre-tokens, until one is an old one behind the edit
        for end in _ends(text, c0):
            cuts.append(end)
            j = bisect_left(self.ends, end - shift, k) if end >= start + len(new) else len(self.ends)
            if j < len(self.ends) and self.ends[j] == end - shift:
                old = j
                break
        old_end = self.stops[old] if old < len(self.stops) else len(self.data)
        sizes = [len(text[a:b].encode()) for a, b in zip([c0, *cuts], cuts)]
        fresh, bounds = bytearray(text[c0 : cuts[-1] if cuts else c0].encode()), list(accumulate(sizes))
        table = self._entries(fresh, bounds, bytes(self.data[b0:old_end]), self.last[b0:old_end], [s - b0 for s in self.stops[keep : old + 1]])
        grown = len(fresh) - (old_end - b0)
        self.stops = self.stops[:keep] + [b0 + s for s in bounds] + [s + grown for s in self.stops[old + 1 :]]
        self.ends = self.ends[:keep] + cuts + [e + shift for e in self.ends[old + 1 :]]
        self.data[b0:old_end], self.last[b0:old_end] = fresh, table
        self.text = text

    def _entries(self, data: bytearray, ends: list[int], old: bytes, entries: array, old_ends: list[int]) -> array:
        """The entries of new pre-tokens: those of an old pre-token's prefix or suffix are taken over where they must be equal."""
        table, begin, self.made = array("i"), 0, 0
        # old pre-tokens by their first place, counted from the front and from the back
        fronts = {b: e for b, e in zip([0, *old_ends[:-1]], old_ends)}
        backs = {len(old) - e: b for b, e in zip([0, *old_ends[:-1]], old_ends)}
        for end in ends:
            at = begin
            if begin in fronts:  # same first bytes, same entries
                limit = min(end, fronts[begin])
                same = _agree(data, old, begin, limit)
                table.extend(entries[begin:same])
                at = same
            back, run = backs.get(len(data) - end), 0
            move = len(old) - len(data)
            while at < end:
                at += 1
                token = self.ranks.last_token(data, begin, at, table)
                table.append(token)
                self.made += 1
                inside = back is not None and at + move > back and at + move - back > self.ranks.lookahead
                run = run + 1 if inside and entries[at + move - 1] == token and old[at + move - 1] == data[at - 1] else 0
                if run >= self.ranks.lookahead and data[at:end] == old[at + move : end + move]:
                    table.extend(entries[at + move : end + move])
                    break
            begin = end
        return table

    def ids(self) -> list[int]:
        out, begin = [], 0
        for end in self.stops:
            out += self.ranks.read_off(self.data, begin, end, self.last)
            begin = end
        return out


def _agree(a: bytearray, b: bytes, begin: int, limit: int) -> int:
    """The place up to which both hold the same bytes from ``begin`` on."""
    while limit > begin and a[begin:limit] != b[begin:limit]:
        # halve: the first half that differs holds the place
        half = (begin + limit) // 2
        if a[begin:half] == b[begin:half]:
            if half == begin:
                return begin
            begin = half
        else:
            limit = half
    return limit


def _ends(text: str, begin: int):
    """Ends of the pre-tokens of text from ``begin`` on, some characters at a time; a cut at a part's end waits for what follows."""
    size = 256
    while begin < len(text):
        part = text[begin : begin + size]
        _, pieces = pre_tokens([part])
        ends = np.cumsum([len(p.decode()) for p in pieces.to_pylist()]).tolist()
        if begin + size < len(text):
            ends = ends[: max(0, len(ends) - SEEN)]
            if not ends:
                size *= 2
                continue
        for e in ends:
            yield begin + e
        begin += ends[-1]


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def ranks_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def encode_runs(texts: list[str], vocab: Ranks):
    """Ids of texts, run by run: (ids, offsets) of neighbouring short texts, or (ids, None) for a block of a long text, whose last one is followed by (None, None)."""
    at = 0
    while at < len(texts):
        end = at
        while end < len(texts) and len(texts[end]) <= BLOCK:
            end += 1
        if end > at:
            counts, found = pre_tokens(texts[at:end])
            coded = found.dictionary_encode()
            flat, lengths = vocab.pieces(coded.dictionary)
            which = np.asarray(coded.indices, dtype=np.int64)
            n = lengths[which]
            yield flat[ragged((np.cumsum(lengths) - lengths)[which], n)], np.concatenate([[0], np.cumsum(n)])[counts]
            at = end
            continue
        for found in blocks(texts[at]):
            coded = found.dictionary_encode()
            flat, lengths = vocab.pieces(coded.dictionary)
            which = np.asarray(coded.indices, dtype=np.int64)
            yield flat[ragged((np.cumsum(lengths) - lengths)[which], lengths[which])], None
        yield None, None
        at += 1


def encode_texts(texts: list[str], vocab: Ranks) -> list[np.ndarray]:
    out, open_ = [], []
    for ids, offsets in encode_runs(texts, vocab):
        if offsets is not None:
            out += [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        elif ids is not None:
            open_.append(ids)
        else:
            out.append(np.concatenate(open_))
            open_ = []
    return out


class Digests:
    """Number of ids of one text, and digests of their decimals and of the bytes they decode to, taken as ids come."""

    def __init__(self, vocab: Ranks):
        self.vocab, self.n, self.ids, self.bytes = vocab, 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: np.ndarray) -> Digests:
        if len(ids):
            v, at = self.vocab, ids.astype(np.int64)
            written = _written(len(v.token_bytes))
            text = written[0][ragged(written[1][at], written[2][at])].tobytes()
            self.ids.update(text if self.n else text[1:])  # each id has a blank before it
            self.bytes.update(v.flat[ragged(v.starts[at], v.lengths[at])].tobytes())
            self.n += len(ids)
        return self

    def row(self) -> tuple[int, str, str]:
        return self.n, self.ids.hexdigest(), self.bytes.hexdigest()


@functools.cache
def _written(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A blank and the decimals of each id, one after another: bytes, starts, lengths."""
    names = [b" %d" % k for k in range(size)]
    n = np.fromiter(map(len, names), np.int64, size)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(n) - n, n


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, the digest of their decimals joined by blanks, and that of the bytes they decode to; nothing is shuffled."""
    path = ranks_path(path)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        v, rows, open_ = ranks(path), [], None
        for ids, offsets in encode_runs(strings(part, "text").to_pylist(), v):
            if offsets is not None:
                rows += [Digests(v).feed(ids[a:b]).row() for a, b in zip(offsets[:-1], offsets[1:])]
            elif ids is not None:
                open_ = (open_ or Digests(v)).feed(ids)
            else:
                rows.append(open_.row())
                open_ = None
        n, id_hash, byte_hash = zip(*rows)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_hash), pa.array(byte_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(by_slice("text", each), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the ids of its text."""
    path = ranks_path(path)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        found = encode_texts(strings(part, "text").to_pylist(), ranks(path))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).astype(np.int32)))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(by_slice("text", each), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and the bytes its ids decode to, and the text (U+FFFD where the bytes are none)."""
    path = ranks_path(path)

    def run(batches):
        v = ranks(path)
        for b in batches:
            ids = (np.array(x or [], np.int64) for x in b.column("ids").to_pylist())
            data = [v.flat[ragged(v.starts[x], v.lengths[x])].tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary()), pa.array([d.decode("utf-8", "replace") for d in data], pa.string())], ["doc_id", "bytes", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary, text string")


TABLES = "doc_id long, text string, last binary, ends binary"


def prefix_tables(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text, last (the last token of every byte prefix of each pre-token, four bytes each) and ends (the pre-tokens' ends in characters): what appends and edits go on from."""
    path = ranks_path(path)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        v, last, ends = ranks(path), [], []
        texts = strings(part, "text").to_pylist()
        for text in texts:
            found = [p for x in blocks(text) for p in x.to_pylist()]
            coded = pa.array(found, pa.large_binary()).dictionary_encode()
            offsets = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1] if found else np.zeros(1, np.int64)
            data = np.frombuffer(coded.dictionary.buffers()[2], np.uint8) if found else np.empty(0, np.uint8)
            sizes, which = np.diff(offsets), np.asarray(coded.indices, dtype=np.int64)
            entries = v.last_tokens(data, offsets[:-1], sizes)[1:]
            last.append(entries[ragged(offsets[:-1][which], sizes[which])].astype("<i4").tobytes())
            ends.append(np.cumsum([len(p.decode()) for p in found], dtype="<i8").tobytes())
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(last, pa.binary()), pa.array(ends, pa.binary())], ["doc_id", "text", "last", "ends"])

    return docs.select("doc_id", "text").mapInArrow(by_slice("text", each), TABLES)


def _open(v: Ranks, text: str, last: bytes, ends: bytes) -> Encoded:
    out = Encoded(v)
    out.text, out.data = text, bytearray(text.encode())
    out.last.frombytes(last)
    out.ends = np.frombuffer(ends, "<i8").tolist()
    bounds = [0, *out.ends]
    out.stops = np.cumsum([len(text[a:b].encode()) for a, b in zip(bounds, bounds[1:])], dtype=np.int64).tolist()
    return out


def edit(tables: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """Tables after one edit of each document named in edits (doc_id, start, stop, new: characters; a start behind the end appends), with the ids and made, the entries made again.

    Documents without an edit stay as they are; tables and edits meet by doc_id, of which edits has at most one row each.
    """
    path = ranks_path(path)

    def run(batches):
        v = ranks(path)
        for b in batches:
            out = []
            for r in b.to_pylist():
                e = _open(v, r["text"] or "", r["last"], r["ends"])
                if r["new"] is not None:
                    start = min(r["start"], len(e.text))
                    e.replace(start, max(start, min(r["stop"], len(e.text))), r["new"])
                out.append((r["doc_id"], e.text, e.last.tobytes(), np.array(e.ends, "<i8").tobytes(), e.ids(), e.made))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int64()))], ["doc_id", "text", "last", "ends", "ids", "made"]) if out else b.slice(0, 0)

    met = tables.join(edits.select("doc_id", "start", "stop", "new"), "doc_id", "left")
    return met.select("doc_id", "text", "last", "ends", "start", "stop", "new").mapInArrow(run, TABLES + ", ids array<int>, made long")
