"""Byte-pair encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Text is cut into pre-tokens with array operations, and each distinct pre-token of a slice is encoded once. The
transducer reads pre-tokens byte by byte, all of a slice in step: for every byte position it finds the one token that
ends there in the encoding of what was read so far. A token may end there if the token before its start can stand in
front of it, and that follows from undoing the merges at their border, latest first (``Vocabulary.fits``). A token starts
within the length of the longest token before its end; that is the sufficient lookahead of the merge list, so whatever
all prefixes in that window agree on is stable and is emitted. Pre-tokens within the window are emitted at their end, as
all their prefixes are in it; longer ones (over STREAMED bytes) run through ``Transducer`` one by one, which emits what is
stable and holds only the window and the tokens not yet agreed on. Long texts pass block by block, ids are hashed and
decoded as they come, so besides the text itself memory does not follow its length.

``merge`` and ``Vocabulary.short_pieces`` merge by rank instead; tests hold both against the library, and packing uses the latter.

Defined results: null and empty texts have no tokens; the special token's text in a document becomes its id,
as the vocabulary file asks; decoding bytes that are no UTF-8 gives U+FFFD per maximal bad part; of merges of one rank the
leftmost goes first; repeated rows are encoded each; a very long text is encoded whole, in blocks of BLOCK characters; an
empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import vocabulary_path
from .text import by_slice, ragged, strings

# The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# The contractions that the pre-token pattern splits off.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
#: Bytes of a pre-token up to which it is merged by rank in arrays, and up to which it is read in step: the lookahead of the public vocabulary.
SHORT, STREAMED = 64, 128
#: Characters of a text that are cut into pre-tokens at a time, and pre-tokens at a block's end that wait for what follows:
#: the text behind them can change the last one and, by a contraction, the one before it.
BLOCK, WAITING = 1 << 18, 3
NEVER = 1 << 40
SLOT_BITS, SPREAD = 20, 0x9E3779B1


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.cache
def char_classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


class Vocabulary:
    """A byte-level merge list: tokens as bytes, ids, and the rank of each merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, (a, b) in enumerate(pairs):
            ranks.setdefault((raw(a), raw(b)), rank)
        self.hold({raw(t): i for t, i in data["model"]["vocab"].items()}, ranks, {t["content"]: t["id"] for t in data["added_tokens"]})

    def hold(self, ids: dict[bytes, int], ranks: dict[tuple[bytes, bytes], int], specials: dict[str, int]) -> None:
        """Tokens with their ids, pairs with the ranks of their merges, and the special tokens, in arrays."""
        self.ids, self.ranks, self.specials = ids, ranks, specials
        size = max([*self.ids.values(), *self.specials.values()]) + 1
        self.token_bytes = [b""] * size
        for b, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.specials.items())]:
            self.token_bytes[i] = b
        self.lookahead = max(map(len, self.ids))
        self.lengths = np.array([len(b) for b in self.token_bytes], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.fill_slots()
        self.border: dict[tuple[bytes, bytes], bool] = {}
        self._grow()

    def merge(self, piece: bytes) -> list[bytes]:
        """Merge by rank, lowest first, leftmost on ties."""
        parts, ranks, none = [piece[i : i + 1] for i in range(len(piece))], self.ranks, 1 << 60
        while len(parts) > 1:
            found = [ranks.get(p, none) for p in zip(parts, parts[1:])]
            best = min(found)
            if best == none:
                break
            i = found.index(best)
            pair = parts[i], parts[i + 1]
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def follows(self, a: bytes, b: bytes) -> bool:
        """Whether b may come right after a: encoding both together gives just these two."""
        if (found := self.border.get((a, b))) is None:
            if len(self.border) > 200_000:
                self.border.clear()
            found = self.border[a, b] = self.merge(a + b) == [a, b]
        return found

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of merging each pair (NEVER if it does not merge) and the id of the merged token."""
        key = (left << 16) | right
        slot = (key * SPREAD & 0xFFFFFFFF) >> (32 - SLOT_BITS)
        rank, merged = np.full(len(key), NEVER, np.int64), np.zeros(len(key), np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.probes):
            at = slot[open_]
            held = self.slot_key[at]
            hit = held == key[open_]
            rank[open_[hit]], merged[open_[hit]] = self.slot_rank[at[hit]], self.slot_merged[at[hit]]
            open_ = open_[~hit & (held >= 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << SLOT_BITS) - 1)
        return rank, merged

    def fill_slots(self) -> None:
        size = 1 << SLOT_BITS
        self.slot_key, self.slot_rank, self.slot_merged = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.probes = 1
        for (a, b), rank in self.ranks.items():
            key = self.ids[a] << 16 | self.ids[b]
            at, n = (key * SPREAD & 0xFFFFFFFF) >> (32 - SLOT_BITS), 1
            while self.slot_key[at] >= 0:
                at, n = (at + 1) & (size - 1), n + 1
            self.slot_key[at], self.slot_rank[at], self.slot_merged[at] = key, rank, self.ids[a + b]
            self.probes = max(self.probes, n)

    def short_pieces(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces at once: ids one after another, and how many each piece has.

        Every round merges, in each piece, the leftmost pair of lowest rank; pieces without such a pair leave.
        """
        ids = self.byte_ids[data[ragged(starts, lengths)]]
        own = np.repeat(np.arange(len(starts)), lengths)
        done_ids, done_own = [], []
        rank = np.full(len(ids), NEVER, np.int64)
        new = np.zeros(len(ids), np.int64)
        if len(ids) > 1:
            rank[:-1], new[:-1] = self.lookup(ids[:-1], ids[1:])
            rank[:-1][own[1:] != own[:-1]] = NEVER
        while len(ids):
            head = np.ones(len(ids), bool)
            head[1:] = own[1:] != own[:-1]
            at = np.flatnonzero(head)
            least = np.minimum.reduceat(rank, at)
            sizes = np.diff(np.append(at, len(ids)))
            least = np.repeat(least, sizes)
            ends = least == NEVER
            if ends.any():
                done_ids.append(ids[ends])
                done_own.append(own[ends])
                go = ~ends
                ids, own, rank, new, least = ids[go], own[go], rank[go], new[go], least[go]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == least)
            first = np.ones(len(hit), bool)
            first[1:] = own[hit[1:]] != own[hit[:-1]]
            hit = hit[first]
            ids[hit] = new[hit]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay)[hit] - 1
            ids, own, rank, new = ids[stay], own[stay], rank[stay], new[stay]
            redo = np.concatenate([moved, moved[moved > 0] - 1])
            rank[redo] = NEVER
            redo = redo[redo + 1 < len(ids)]
            redo = redo[own[redo] == own[redo + 1]]
            rank[redo], new[redo] = self.lookup(ids[redo], ids[redo + 1])
        if not done_ids:
            return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        ids, own = np.concatenate(done_ids), np.concatenate(done_own)
        return ids[np.argsort(own, kind="stable")].astype(np.uint32), np.bincount(own, minlength=len(starts))

    def _grow(self) -> None:
        """The last merge of each token (rank, left and right part; rank -1 for bytes), and the tree of all tokens' bytes."""
        size = len(self.token_bytes)
        self.rank, self.left, self.right = np.full(size, NEVER, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.rank[self.byte_ids] = -1
        merges = np.array([(len(a) + len(b), rank, self.ids[a + b], self.ids[a], self.ids[b]) for (a, b), rank in self.ranks.items()], np.int64).reshape(-1, 5)
        merges = merges[np.lexsort((-merges[:, 1], merges[:, 0]))]  # parts are shorter than what they make
        for group in np.split(merges, np.flatnonzero(np.diff(merges[:, 0])) + 1):
            _, rank, token, i, j = group.T
            # the first merge whose parts can stand side by side until then is the one that makes the token
            made = (self.rank[i] < rank) & (self.rank[j] < rank)
            made[made] = self.fits(i[made], j[made], rank[made])
            self.rank[token[made]], self.left[token[made]], self.right[token[made]] = rank[made], i[made], j[made]
        nodes: dict[tuple[int, int], int] = {}
        self.ends = [-1]
        for token, i in self.ids.items():
            if self.rank[i] == NEVER:
                continue
            node = 0
            for byte in token:
                key = (node, byte)
                if (node := nodes.get(key, 0)) == 0:
                    node = nodes[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = i
        self.ends = np.array(self.ends, np.int64)
        keys = np.fromiter((n << 8 | b for n, b in nodes), np.int64, len(nodes))
        order = np.argsort(keys)
        self.step_keys, self.step_nodes = keys[order], np.fromiter(nodes.values(), np.int64, len(nodes))[order]
        self.step_from = np.searchsorted(self.step_keys, np.arange(len(self.ends) + 1) << 8)
        self.step_first = np.zeros(256, np.int64)
        own = self.step_keys < 256
        self.step_first[self.step_keys[own]] = self.step_nodes[own]

    def fits(self, a: np.ndarray, b: np.ndarray, before: int | np.ndarray = NEVER) -> np.ndarray:
        """Whether token b can stand right after token a: no merge of rank under ``before`` crosses the border.

        Merges are undone from the latest on. At each step the two parts at the border must not have merged before the
        part that was undone last came about; of equal ranks the one further left goes first.
        """
        out = np.ones(len(a), bool)
        at, limit = np.arange(len(a)), np.broadcast_to(np.asarray(before, np.int64), len(a))
        while len(at):
            crossed = self.lookup(a, b)[0] < limit
            out[at[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & (np.maximum(ra, rb) >= 0)
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            later = ra > rb
            limit = np.where(later, ra, rb + 1)
            a, b = np.where(later, self.right[a], a), np.where(later, b, self.left[b])
        return out

    def last_tokens(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For many pre-tokens, all read in step: the token that ends the encoding of each byte prefix, at the place of the prefix's end among all bytes."""
        total, flat = int(lengths.sum()), ragged(starts, lengths)
        byte = data[flat].astype(np.int64)
        begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
        end = np.repeat(np.cumsum(lengths), lengths)
        # all places where a token's bytes stand
        at, node, depth, found = np.arange(total), self.step_first[byte], 1, []
        while len(at):
            token = self.ends[node]
            here = token >= 0
            found.append((at[here], at[here] + depth, token[here]))
            more = at + depth < end[at]
            at, node = at[more], node[more]
            key = node << 8 | byte[at + depth]
            place = np.minimum(np.searchsorted(self.step_keys, key), len(self.step_keys) - 1)
            hit = self.step_keys[place] == key
            at, node, depth = at[hit], self.step_nodes[place[hit]], depth + 1
        if not found:
            return np.full(total + 1, -1, np.int64)
        first, stop, token = (np.concatenate(x) for x in zip(*found))
        read = stop - begin[first]  # bytes of the pre-token up to the token's end
        order = np.argsort(read, kind="stable")
        first, stop, token, read = first[order], stop[order], token[order], read[order]
        bounds = np.searchsorted(read, np.arange(1, int(read.max()) + 2))
        last = np.full(total + 1, -1, np.int64)  # the token that ends at a position
        for a, b in zip(bounds[:-1], bounds[1:]):
            f, e, t = first[a:b], stop[a:b], token[a:b]
            inside = f > begin[f]
            fine = np.ones(b - a, bool)
            fine[inside] = self.fits(last[f[inside]], t[inside])
            last[e[fine]] = t[fine]
        return last

    def walk_back(self, last: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of pre-tokens from their ends on: ids one after another, and how many each has."""
        if not lengths.any():
            return np.empty(0, np.uint32), np.zeros(len(lengths), np.int64)
        position, own = np.cumsum(lengths), np.arange(len(lengths))
        own, position = own[lengths > 0], position[lengths > 0]
        ids, owners, left = [], [], np.cumsum(lengths) - lengths
        while len(own):
            t = last[position]
            ids.append(t)
            owners.append(own)
            position = position - self.lengths[t]
            go = position > left[own]
            own, position = own[go], position[go]
        ids, owners = np.concatenate(ids)[::-1], np.concatenate(owners)[::-1]
        return ids[np.argsort(owners, kind="stable")].astype(np.uint32), np.bincount(owners, minlength=len(lengths))

    def in_step(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pre-tokens by the transducer, all read in step: ids one after another, and how many each has."""
        return self.walk_back(self.last_tokens(data, starts, lengths), lengths)

    def pieces(self, pieces: pa.Array, in_step: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after another, and how many each has; by the transducer, or short ones by rank."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
        data = np.frombuffer(pieces.buffers()[2], np.uint8) if len(pieces) else np.empty(0, np.uint8)
        lengths = np.diff(offsets)
        short = lengths <= (STREAMED if in_step else SHORT)
        ids, n = (self.in_step if in_step else self.short_pieces)(data, offsets[:-1][short], lengths[short])
        if short.all():
            return ids, n
        counts = np.zeros(len(pieces), np.int64)
        counts[short] = n
        long_ids = {int(k): self.long_piece(data[offsets[k] : offsets[k + 1]].tobytes()) for k in np.flatnonzero(~short)}
        for k, x in long_ids.items():
            counts[k] = len(x)
        begins = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        out[ragged(begins[short], n)] = ids
        for k, x in long_ids.items():
            out[begins[k] : begins[k] + len(x)] = x
        return out, counts

    def long_piece(self, piece: bytes) -> np.ndarray:
        machine = Transducer(self)
        tokens = [t for at in range(0, len(piece), 4096) for t in machine.feed(piece[at : at + 4096])] + machine.finish()
        return np.array([self.ids[t] for t in tokens], np.uint32)


class Transducer:
    """Encodes one pre-token of any length, fed in parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.window = vocabulary, vocabulary.lookahead
        self.tail = b""
        self.at = 0
        #: For each of the last prefixes: its chain of tokens, newest first, as (token, chain before it).
        self.chains: dict[int, tuple | None] = {0: None}

    def feed(self, data: bytes) -> list[bytes]:
        ids, follows, out = self.vocabulary.ids, self.vocabulary.follows, []
        for k in range(len(data)):
            self.tail = (self.tail + data[k : k + 1])[-self.window :]
            self.at += 1
            for n in range(1, len(self.tail) + 1):
                token = self.tail[-n:]
                if token in ids and (self.at - n) in self.chains:
                    before = self.chains[self.at - n]
                    if before is None or follows(before[0], token):
                        self.chains[self.at] = (token, before)
                        break
            self.chains.pop(self.at - self.window, None)
            if self.at % (8 * self.window) == 0:
                out += self.emit()
        return out

    def emit(self) -> list[bytes]:
        """Tokens on which all prefixes in the window agree; the last of them stays, as what follows is held against it."""
        lines = []
        for chain in self.chains.values():
            line = []
            while chain is not None:
                line.append(chain[0])
                chain = chain[1]
            lines.append(line[::-1])
        if not lines:
            return []
        same = 0
        while all(len(x) > same for x in lines) and len({x[same] for x in lines}) == 1:
            same += 1
        if same < 2:
            return []
        done = lines[0][: same - 1]
        for at, line in zip(list(self.chains), lines):
            chain = None
            for token in line[same - 1 :]:
                chain = (token, chain)
            self.chains[at] = chain
        return done

    def finish(self) -> list[bytes]:
        chain, out = self.chains[self.at], []
        while chain is not None:
            out.append(chain[0])
            chain = chain[1]
        return out[::-1]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def pre_tokens(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """Pre-tokens of all texts, cut as the pattern of byte-level vocabularies does: number of them before each text's first one, and the pieces."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    kind = char_classes()[codes]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    breaks = np.cumsum(lengths + 1) - 1
    kind[breaks] = BREAK
    n = len(codes)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    start[breaks] = True
    start[breaks[:-1] + 1] = True
    space = kind == SPACE
    after = np.empty(n, np.uint8)
    after[:-1], after[-1] = kind[1:], BREAK
    last = space & (after != SPACE) & (after != BREAK)  # of white space before something else: a piece of its own,
    start |= last
    joins = np.flatnonzero(last & (codes == 0x20))  # or the beginning of what follows, if it is a blank
    start[joins + 1] = False
    quote = np.flatnonzero((codes == 0x27) & start)
    for q in quote[(after[quote] == LETTER)] if len(quote) else ():
        rest = joined[q : q + 3]
        for c in CONTRACTIONS:
            if rest.startswith(c):
                start[q + 1] = False
                start[q + len(c)] = True
                break
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    begins = np.cumsum(width) - width
    first = np.flatnonzero(start)
    ends = np.append(first[1:], n)
    keep = kind[first] != BREAK
    data = joined.encode("utf-8")
    at, to = begins[first], np.append(begins[first[1:]], len(data))
    offsets = np.append(at, len(data))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    del ends, to
    owner_starts = np.append(0, breaks[:-1] + 1) if len(texts) else np.zeros(0, np.int64)
    kept = np.concatenate([[0], np.cumsum(keep)])
    counts = kept[np.searchsorted(first, owner_starts)]
    return np.append(counts, kept[-1]), pieces.filter(pa.array(keep))


def blocks(text: str, size: int = BLOCK) -> Iterator[pa.Array]:
    """The pre-tokens of a long text, block by block; only the text, one block's arrays, and the pre-tokens that wait are held."""
    rest = ""
    for at in range(0, len(text), size):
        part = rest + text[at : at + size]
        _, pieces = pre_tokens([part])
        if at + size >= len(text):
            yield pieces
            return
        waits = max(0, len(pieces) - WAITING)
        tail = b"".join(pieces.slice(waits).to_pylist())
        rest = tail.decode()
        if waits:
            yield pieces.slice(0, waits)


def encode_long(text: str, vocab: Vocabulary, in_step: bool = False) -> np.ndarray:
    """Ids of one long text without special tokens."""
    out = []
    for pieces in blocks(text):
        coded = pieces.dictionary_encode()
        flat, lengths = vocab.pieces(coded.dictionary, in_step)
        which = np.asarray(coded.indices, dtype=np.int64)
        out.append(flat[ragged((np.cumsum(lengths) - lengths)[which], lengths[which])])
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def encode_texts(texts: list[str], vocab: Vocabulary, in_step: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and the offsets at which each text's ids begin."""
    special = [s for s in vocab.specials if any(s in t for t in texts)]
    if special:
        return _with_specials(texts, vocab, in_step)
    if any(len(t) > BLOCK for t in texts):
        parts = [encode_long(t, vocab, in_step) if len(t) > BLOCK else encode_texts([t], vocab, in_step)[0] for t in texts]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    counts, pieces = pre_tokens(texts)
    coded = pieces.dictionary_encode()
    flat, lengths = vocab.pieces(coded.dictionary, in_step)
    which = np.asarray(coded.indices, dtype=np.int64)
    n = lengths[which]
    ids = flat[ragged((np.cumsum(lengths) - lengths)[which], n)]
    return ids, np.concatenate([[0], np.cumsum(n)])[counts]


def _with_specials(texts: list[str], vocab: Vocabulary, in_step: bool = False) -> tuple[np.ndarray, np.ndarray]:
    import re

    split = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocab.specials, key=len, reverse=True)) + ")")
    parts = [split.split(t) for t in texts]
    plain = [p for part in parts for p in part[::2]]
    ids, offsets = encode_texts(plain, vocab, in_step)
    out, begins, k, total = [], [0], 0, 0
    for part in parts:
        for i, p in enumerate(part):
            if i % 2:
                out.append(np.array([vocab.specials[p]], np.uint32))
            else:
                out.append(ids[offsets[k] : offsets[k + 1]])
                k += 1
            total += len(out[-1])
        begins.append(total)
    return np.concatenate(out), np.array(begins, np.int64)


class Decoder:
    """Turns ids into text as they come: bytes that do not end a character wait for the next ids."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.state = vocab, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray, last: bool = False) -> str:
        v = self.vocab
        data = v.flat[ragged(v.starts[ids], v.lengths[ids])] if len(ids) else np.empty(0, np.uint8)
        return self.state.decode(data.tobytes(), last)


def decode(ids: np.ndarray, vocab: Vocabulary, block: int = 1 << 16) -> list[str]:
    """The text of ids, in parts of at most ``block`` ids."""
    machine = Decoder(vocab)
    return [machine.feed(ids[at : at + block]) for at in range(0, len(ids), block)] + [machine.feed(ids[:0], True)]


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and the ids of its text (``ids array<int>``), for any table with these two columns."""
    path = vocabulary_path(path)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, offsets = encode_texts(strings(part, "text").to_pylist(), vocabulary(path), True)
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    return docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text").mapInArrow(by_slice("text", each), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of a table of doc_id and ids."""
    path = vocabulary_path(path)

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            texts = ["".join(decode(np.array(x or [], np.int64), v)) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


class Digests:
    """Number of ids of one text, and digests of the ids and of the text that they decode to, taken as ids come."""

    def __init__(self, vocab: Vocabulary):
        self.decoder, self.n, self.ids, self.text = Decoder(vocab), 0, hashlib.sha256(), hashlib.sha256()

    def feed(self, ids: np.ndarray, block: int = 1 << 16) -> Digests:
        self.n += len(ids)
        self.ids.update(ids.astype("<u4").tobytes())
        for at in range(0, len(ids), block):
            self.text.update(self.decoder.feed(ids[at : at + block].astype(np.int64)).encode())
        return self

    def row(self) -> tuple[int, str, str]:
        self.text.update(self.decoder.feed(np.empty(0, np.int64), True).encode())
        return self.n, self.ids.hexdigest(), self.text.hexdigest()


def stream(text: str, vocab: Vocabulary) -> Iterator[np.ndarray]:
    """The ids of a text, block by block; special tokens where their strings stand."""
    import re

    parts = re.split("(" + "|".join(re.escape(s) for s in sorted(vocab.specials, key=len, reverse=True)) + ")", text) if vocab.specials else [text]
    held: list[str] = []  # short parts and special tokens, encoded together
    size = 0
    for k, part in enumerate(parts):
        if held and (size >= BLOCK or len(part) > BLOCK):
            yield encode_texts(["".join(held)], vocab, True)[0]
            held, size = [], 0
        if k % 2 == 0 and len(part) > BLOCK:
            for pieces in blocks(part):
                coded = pieces.dictionary_encode()
                flat, lengths = vocab.pieces(coded.dictionary, True)
                which = np.asarray(coded.indices, dtype=np.int64)
                yield flat[ragged((np.cumsum(lengths) - lengths)[which], lengths[which])]
        else:
            held.append(part)
            size += len(part)
    if held:
        yield encode_texts(["".join(held)], vocab, True)[0]


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, their digest, and the digest of the text that they decode to.

    Each text is encoded and decoded in the task that read it, a long one block by block; nothing is shuffled.
    """
    path = vocabulary_path(path)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        v, texts = vocabulary(path), strings(part, "text").to_pylist()
        rows: list[tuple[int, str, str]] = []
        if len(texts) == 1 and len(texts[0]) > BLOCK:  # a text longer than a slice comes alone
            one = Digests(v)
            for ids in stream(texts[0], v):
                one.feed(ids)
            rows.append(one.row())
        else:
            ids, offsets = encode_texts(texts, v, True)
            rows += [Digests(v).feed(ids[a:b]).row() for a, b in zip(offsets[:-1], offsets[1:])]
        n, id_hash, text_hash = zip(*rows)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(id_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(by_slice("text", each), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
