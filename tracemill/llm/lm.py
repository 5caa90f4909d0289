"""Language-model scores by online logistic context mixing over the bits of a token code.

Tokens are words and one end per document. A token's code begins with match bits: is it what followed the last three
words most often, and if not, what followed the last two? Then come the bits of a tree whose leaves hold the ``head``
most frequent training tokens and one escape for all others: its first levels part words by the language they are
mostly seen in, later ones by frequency.

Match bits are predicted from hashed contexts of whole words, counted over all training documents. A block of text asks
with its distinct rows (hash of the two words before, the third, the next token, trained or not); they are dealt to parts
by the two words, so each part knows all rows of its contexts, counts what follows and answers with a byte for each row
and context: how often it was seen, with the predicted token, and whether that comes. Where two words are so frequent that
their rows might not fit a task, rows are dealt by three words, and what follows the two is counted by further parts, whose
leading tokens every task gets. Blocks meet their answers again,
and the text, which is read a second time, tells which row a position was. Tokens beyond the head ask for their counts
in the same way. A context's hash has 12 bits more than numbers all positions need (46 at most).

Tree bits are predicted by hashed contexts (none, the groups of the last three words, the last word, the word before
it), whose counts come from all training documents. Predictions are mixed in the logistic domain by weights that a gate
selects (for a match bit how often its context was seen and how many matches ran up to here, for a tree bit the level).
All weights are fitted to all training texts: for tree bits each slice of text gives its log-likelihood to second order
about weights that suit it, and the sum is solved; for match bits the corpus is tallied by gate and odds. A position of a
training document leaves its own occurrence out of its match contexts, in the fit and in its score: else each such
document would be known by heart from itself. An adaptive stage then corrects match predictions by how often they came
true, and the weights of tree bits are refined online in each document, block by block.

The match bit is a mixture: with its probability the token is the predicted one, else the rest of the code decides, so
that all probabilities sum to one. Below the tree's levels a token has its count's share of the leaf. Escaped tokens
share what the escape gets in proportion to count + 1, unseen ones counting as one more token.

Base scores need the exact count of every token: those in the head are at hand, the others are asked for. The documents
are read several times and must come in the same partitions and order, as files do; where the number of a block's rows in any part differs, that is an error.

Defined results: a null or empty text is one end token; a null doc_id counts as the text ''; without training
documents N, V and n_known are 0 and the base is log10(1) = 0 per token, as is the score; repeated rows are scored
each; of tokens with about one count at the head's border a share by hash is in it; of continuations of one count the one with the
smaller hash is predicted; a very long text is scored whole, alone in its slice; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import cut
from .text import MIX, by_slice, mixed, strings, text_slices, words_of

HEAD = 100_000  # most frequent tokens kept in each task
LEVELS = 6
LEAVES = 1 << LEVELS
GROUPS = 8  # word groups: the languages with most tokens, and the rest
BUCKETS = 1024  # hashed contexts of one word
ORDERS = (3, 2)  # words that make up the context of each match bit
PART_BYTES, MOST_PARTS = 6 << 20, 1_000_000  # text of a part; parts are larger rather than more
SHARE = 16  # one of so many rows is looked at for keys with more text than a part
WINDOW = 16  # bytes from a word's start that the min-hash is taken over
BLOCK_BYTES, COUNT_BYTES = 8 << 20, 12 << 20  # text that asks together, and text whose contexts are counted in a task
HOT = 1 << 17  # expected times from which two words are a context that is dealt to all parts
SEEN, RUN, BINS = 4, 4, 24  # states of a gate (times the context was seen, matches up to here), and bins of the adaptive stage
CELLS, FEW, ODDS_FROM, ODDS_STEP = 128, 1 + SEEN * (SEEN - 1) // 2, -10.0, 0.25  # what a context says: its counts where it was seen fewer than SEEN times, else a step of its odds
STEPS = 4  # of Newton's method
ROW_BYTES = 64  # what a row counts for besides its text: rows without text are work as well
COUNTED = 8 << 20  # bytes of text whose tokens are counted at a time before they are exchanged
BLOCK, RATE = 128, 0.02
CONTEXTS = (GROUPS**3, BUCKETS, BUCKETS)
END = ""


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(7)) == 2


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of each text and an end after them: offsets, codes, distinct tokens, of which the last is the end."""
    offsets, codes, distinct = words_of(texts, lower=True)
    n = len(offsets) - 1
    out = np.full(len(codes) + n, len(distinct), np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(codes)) + owner] = codes
    return offsets + np.arange(n + 1), out, pa.concat_arrays([distinct.cast(pa.large_string()), pa.array([END], pa.large_string())])


def token_counts(docs: DataFrame) -> DataFrame:
    """token, n, lang (the one it is mostly seen in) over all texts of docs (text, lang)."""

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        offsets, codes, distinct = tokens_of(strings(part, "text"))
        langs = pc.fill_null(part.column("lang"), "").dictionary_encode()
        owner = np.repeat(np.asarray(langs.indices, dtype=np.int64), np.diff(offsets))
        pairs, n = np.unique(codes * len(langs.dictionary) + owner, return_counts=True)
        return pa.RecordBatch.from_arrays([distinct.cast(pa.string()).take(pa.array(pairs // len(langs.dictionary))), langs.dictionary.take(pa.array(pairs % len(langs.dictionary))), pa.array(n)], ["token", "lang", "n"])

    rows = docs.select("text", "lang").mapInArrow(by_slice("text", each, COUNTED), "token string, lang string, n long")
    by_lang = rows.groupBy("token", "lang").agg(F.sum("n").alias("n"))
    return by_lang.groupBy("token").agg(F.sum("n").alias("n"), F.max_by("lang", F.struct("n", "lang")).alias("lang"))


class CodeTree:
    """Leaf of each head token and of the escape (the last symbol), and the path to each leaf."""

    def __init__(self, counts: np.ndarray, groups: np.ndarray):
        order = np.lexsort((-counts, groups))
        weight = counts[order].astype(float)
        total = np.concatenate([[0.0], np.cumsum(weight)])
        edges = np.flatnonzero(np.diff(groups[order])) + 1
        self.leaf = np.zeros(len(counts), np.int64)
        self.node = np.zeros((LEAVES, LEVELS), np.int64)
        self.bit = np.zeros((LEAVES, LEVELS), np.int8)
        self.depth = np.zeros(LEAVES, np.int64)
        self.mass = np.zeros(LEAVES)
        self.n_leaves = 0

        def part(a: int, b: int, path: list[tuple[int, int]], node: int):
            if b - a == 1 or len(path) == LEVELS:
                k = self.n_leaves
                self.n_leaves += 1
                self.leaf[order[a:b]] = k
                self.depth[k], self.mass[k] = len(path), total[b] - total[a]
                for d, (n, bit) in enumerate(path):
                    self.node[k, d], self.bit[k, d] = n, bit
                return
            inside = edges[(edges > a) & (edges < b)]
            half = (total[a] + total[b]) / 2
            if len(inside):
                at = int(inside[np.argmin(np.abs(total[inside] - half))])
            else:
                at = min(max(int(np.searchsorted(total, half)), a + 1), b - 1)
            part(a, at, [*path, (node, 0)], 2 * node + 1)
            part(at, b, [*path, (node, 1)], 2 * node + 2)

        part(0, len(counts), [], 0)


def stretch(p):
    return np.log(p / (1 - p))


def bit_tables(tree: CodeTree, joint: np.ndarray) -> np.ndarray:
    """For each context and node the stretched probability of a one, from counts of (context, leaf); shrunk towards even odds of the tree."""
    one = np.zeros((joint.shape[0], LEAVES))
    both = np.zeros((joint.shape[0], LEAVES))
    for k in range(tree.n_leaves):
        for d in range(tree.depth[k]):
            both[:, tree.node[k, d]] += joint[:, k]
            one[:, tree.node[k, d]] += joint[:, k] * tree.bit[k, d]
    prior = (one.sum(axis=0) + 0.4) / (both.sum(axis=0) + 0.8)
    return stretch(np.clip((one + 2 * prior) / (both + 2), 1e-6, 1 - 1e-6)).astype(np.float32)


class Mixer:
    """Everything a task needs to score texts; pickled once per task."""

    def __init__(self, tokens: list[str], counts: np.ndarray, groups: np.ndarray, escape_mass: float, n: int, v: int, tail_n: int, tail_v: int):
        symbols = np.append(counts, escape_mass)
        self.tree = CodeTree(symbols, np.append(groups, GROUPS))
        self.tokens, self.counts, self.groups = pa.array(tokens, pa.large_string()), np.append(counts, 0), np.append(groups, GROUPS - 1)
        self.n, self.v, self.tail = n, v, math.log10(max(1, tail_n + tail_v + 1))
        self.below = np.log10(symbols / self.tree.mass[self.tree.leaf])
        self.base = np.log10((self.counts + 1) / max(1, n + v + 1))
        self.tables: list[np.ndarray] = []
        self.weights = np.full((LEVELS, 1 + len(CONTEXTS)), 0.3)

    def tokens_in(self, texts: pa.Array):
        """Offsets, symbol of each token (the escape for tokens beyond the head), token codes and distinct tokens."""
        offsets, codes, distinct = tokens_of(texts)
        return offsets, self.symbols_of(distinct)[codes], codes, distinct

    def symbols_of(self, distinct: pa.Array) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.index_in(distinct, value_set=self.tokens), len(self.tokens)), dtype=np.int64)

    def look(self, texts: pa.Array):
        """Offsets, symbol of each token (the escape for tokens beyond the head), contexts, token codes and distinct tokens."""
        offsets, codes, distinct = tokens_of(texts)
        symbol = self.symbols_of(distinct)
        endings = pc.utf8_slice_codeunits(distinct, -2).dictionary_encode()
        hashed = np.fromiter(map(hash_of, endings.dictionary.to_pylist()), np.int64, len(endings.dictionary))[np.asarray(endings.indices)]
        bucket = np.where(symbol < BUCKETS * 3 // 4, symbol, BUCKETS * 3 // 4 + hashed % (BUCKETS // 4))[codes]
        symbols = symbol[codes]
        group = self.groups[symbols]
        starts = np.zeros(len(codes), bool)
        starts[offsets[:-1]] = True
        place_in = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))

        def back(x, k, none):
            out = np.full(len(x), none, np.int64)
            out[k:] = x[:-k] if k else x
            out[place_in < k] = none
            return out

        g = [back(group, k, GROUPS - 1) for k in (1, 2, 3)]
        contexts = ((g[0] * GROUPS + g[1]) * GROUPS + g[2], back(bucket, 1, BUCKETS - 1), back(bucket, 2, BUCKETS - 1))
        return offsets, symbols, contexts, codes, distinct

    def inputs(self, leaf: np.ndarray, contexts, level: int) -> np.ndarray:
        node = self.tree.node[:, level].astype(np.int32)[leaf]
        out = np.empty((len(leaf), 1 + len(contexts)), np.float32)
        out[:, 0] = self.tables[0][0].take(node)
        for k, (t, c) in enumerate(zip(self.tables[1:], contexts), 1):
            out[:, k] = t.ravel().take(c * np.int32(LEAVES) + node)
        return out

    def learn(self, leaf: np.ndarray, contexts, steps: int = STEPS) -> None:
        """Newton's steps towards the weights that suit these tokens best, held to 0.3 as by one bit."""
        for level, w in enumerate(self.weights):
            here, around = leaf, contexts
            if not (live := self.tree.depth[leaf] > level).all():
                here, around = leaf[live], [c[live] for c in contexts]
            x, bit = self.inputs(here, around, level), self.tree.bit[here, level].astype(np.float32)
            for _ in range(steps):
                p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))  # in single precision, as the inputs are
                gram = (x * (p * (1 - p))[:, None]).T @ x
                w += np.linalg.solve(gram.astype(float) + np.eye(len(w)), (x.T @ (bit - p)).astype(float) - (w - 0.3))

    def form(self, leaf: np.ndarray, contexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Level, cell and value of each level's Gram matrix at the weights that these tokens ask for, with the vector that it takes them to; such forms add up."""
        start, self.weights = self.weights, np.full_like(self.weights, 0.3)
        self.learn(leaf, contexts, 2)
        found = np.zeros((LEVELS, self.weights.shape[1], self.weights.shape[1] + 1))
        for level, w in enumerate(self.weights):
            live = self.tree.depth[leaf] > level
            here, around = (leaf, contexts) if live.all() else (leaf[live], [c[live] for c in contexts])
            x, bit = self.inputs(here, around, level), self.tree.bit[here, level].astype(np.float32)
            p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
            found[level, :, :-1] = (x * (p * (1 - p))[:, None]).T @ x
            found[level, :, -1] = found[level, :, :-1] @ w + (x.T @ (bit - p)).astype(float)
        self.weights, size = start, found[0].size
        return np.repeat(np.arange(LEVELS), size), np.tile(np.arange(size), LEVELS), found.ravel()

    def leaf_bits(self, offsets: np.ndarray, leaf: np.ndarray, contexts) -> np.ndarray:
        """Natural logarithm of each token's probability down to its leaf, weights refined block by block in each document."""
        n_docs = len(offsets) - 1
        out = np.zeros(len(leaf), np.float64)
        own = np.repeat(np.arange(n_docs), np.diff(offsets))
        block = (np.arange(len(leaf)) - offsets[:-1][own]) // BLOCK
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(int(block.max(initial=-1)) + 2))
        # everything in the order of blocks, so that a block of all documents is one run
        leaf, contexts, own, sums = leaf[order], [c[order] for c in contexts], own[order], np.zeros(len(leaf))
        for level in range(LEVELS):
            weights = np.repeat(self.weights[level][None, :].astype(np.float32), n_docs, axis=0)
            x = self.inputs(leaf, contexts, level)
            sign = np.where(self.tree.bit[leaf, level] == 1, 1, -1).astype(np.float32)
            live = (self.tree.depth[leaf] > level).astype(np.float32)
            for a, b in zip(ends[:-1], ends[1:]):
                at = slice(a, b)
                w, xs = own[at], x[at]
                z = np.einsum("ij,ij->i", weights[w], xs) * sign[at]
                z = np.clip(z, -30, 30)
                sums[at] -= np.log1p(np.exp(-z)) * live[at]
                step = live[at] * sign[at] / (1 + np.exp(z))
                size = np.bincount(w, live[at], n_docs)
                for k in range(weights.shape[1]):
                    weights[:, k] += RATE * np.bincount(w, step * xs[:, k], n_docs) / np.sqrt(np.maximum(size, 1))
        out[order] = sums
        return out

    def tree_scores(self, offsets: np.ndarray, symbols: np.ndarray, contexts) -> np.ndarray:
        """log10 of each token's probability by the tree; of an escaped one that of the escape over all its tokens' counts + 1."""
        value = self.leaf_bits(offsets, self.tree.leaf[symbols], contexts) / math.log(10) + self.below[symbols]
        value[symbols == len(self.tokens)] -= self.tail
        return value


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """A 64-bit hash of each token, the same in every task: a polynomial of its bytes, mixed."""
    n = len(tokens)
    ends = np.cumsum(np.asarray(pc.binary_length(tokens), dtype=np.int64))
    raw = tokens.take(pa.array(np.arange(n))).buffers()[2]
    if not n or not ends[-1]:
        return mixed(np.zeros(n, np.uint64))
    data = np.frombuffer(raw, np.uint8)[: ends[-1]].astype(np.uint64) + np.uint64(1)
    lengths = np.diff(np.append(0, ends))
    place = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    power = np.cumprod(np.append(np.uint64(1), np.full(int(lengths.max()), MIX)), dtype=np.uint64)
    total = np.append(np.uint64(0), np.cumsum(data * power[place], dtype=np.uint64))
    return mixed(total[ends] - total[ends - lengths] + lengths.astype(np.uint64))


class Successors:
    """For contexts (hashes), the token (a number below 2**32) that follows most often in training, and how often the next best does; ``trained``: how often each row occurs there."""

    def __init__(self, context: np.ndarray, token: np.ndarray, trained: np.ndarray):
        distinct, self.at = np.unique(context, return_inverse=True)
        self.token, size, many = token, len(distinct), int(token.max(initial=0)) + 1
        rows = np.flatnonzero(trained)
        pairs = self.at[rows] * many + token[rows]
        order = np.argsort(pairs, kind="stable")
        pairs, times = pairs[order], trained[rows][order].astype(np.int64)
        first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
        n = np.add.reduceat(times, first) if len(pairs) else times
        at, word = pairs[first] // many, pairs[first] % many
        order = np.argsort((at + 1) * (int(n.max(initial=0)) + 1) - n, kind="stable")  # by context, the most frequent first
        at, word, n = at[order], word[order], n[order]
        lead = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.empty(0, np.int64)
        self.best, self.n, self.next, self.total = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.bincount(at, n, size).astype(np.int64)
        self.best[at[lead]], self.n[at[lead]] = word[lead], n[lead]
        after = lead[np.append(lead[1:], len(at)) - lead > 1] + 1
        self.next[at[after]] = n[after]

    def look(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each position how often its context was seen, how often with the predicted token, and whether that comes; ``own`` positions leave themselves out."""
        return foretold(self.total[self.at], self.n[self.at], self.next[self.at], self.token == self.best[self.at], own)


def foretold(total: np.ndarray, most: np.ndarray, after: np.ndarray, hit: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How often a context was seen, how often with the predicted token, and whether that comes, from all, the best and the next best count."""
    best = most - (own & hit)
    lost = own & hit & (best < after)
    best = np.where(lost, after, best)
    return total - own, best, hit & ~lost & (best > 0)


def cells_of(n: np.ndarray, best: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """A byte for what a context says at a position: 0 without a prediction, else twice its cell, and one more if the predicted token comes."""
    odds = np.log((best + 0.3) / (np.maximum(n - best, 0) + 0.3))
    wide = FEW + np.clip(np.floor((odds - ODDS_FROM) / ODDS_STEP), 0, CELLS - FEW - 1)
    cell = np.where(n < SEEN, (np.minimum(n, SEEN) - 1) * np.minimum(n, SEEN) // 2 + best, wide).astype(np.int64)
    return np.where(best > 0, 2 * cell + hit, 0).astype(np.uint8)


def cell_inputs() -> tuple[np.ndarray, np.ndarray]:
    """How often the context of each cell was seen less one (``SEEN`` - 1: that or more), and the logarithm of its odds."""
    seen, x = np.zeros(CELLS, np.int64), np.zeros(CELLS)
    for n in range(1, SEEN):
        for best in range(1, n + 1):
            seen[(n - 1) * n // 2 + best], x[(n - 1) * n // 2 + best] = n - 1, math.log((best + 0.3) / (n - best + 0.3))
    seen[FEW:], x[FEW:] = SEEN - 1, ODDS_FROM + ODDS_STEP * (np.arange(CELLS - FEW) + 0.5)
    return seen, x


def runs_of(hit: np.ndarray, place: np.ndarray) -> np.ndarray:
    """How many matches run up to each position, less than RUN."""
    run, alive = np.zeros(len(hit), np.int64), np.ones(len(hit), bool)
    for k in range(1, RUN):
        before = np.zeros(len(hit), bool)
        before[k:] = hit[:-k] if len(hit) > k else before[k:]
        alive &= before & (place >= k)
        run += alive
    return run


class MatchBit:
    """Predicts whether the token is the one that a context makes expect: gated weights, then an adaptive stage. For each run and cell."""

    def __init__(self, seen: np.ndarray):
        """seen: times (run, cell, whether the token came) occurred at positions of training texts."""
        said, x = cell_inputs()
        gate, x = (said * RUN + np.arange(RUN)[:, None]).ravel(), np.tile(x, RUN)
        misses, hits = seen.reshape(-1, 2).astype(float).T
        times, gates = misses + hits, SEEN * RUN
        weights = np.tile([-0.5, 0.7], (gates, 1))
        start = weights.copy()

        def mixed_odds():
            return np.clip(weights[gate, 0] + weights[gate, 1] * x, -12, 12)

        for _ in range(STEPS):
            p = 1 / (1 + np.exp(-mixed_odds()))
            h, g = times * p * (1 - p), hits - times * p
            gram = np.empty((gates, 2, 2))
            gram[:, 0, 0] = np.bincount(gate, h, gates) + 1
            gram[:, 0, 1] = gram[:, 1, 0] = np.bincount(gate, h * x, gates)
            gram[:, 1, 1] = np.bincount(gate, h * x * x, gates) + 1
            slope = np.stack([np.bincount(gate, g, gates), np.bincount(gate, g * x, gates)], axis=1) - (weights - start)
            weights = np.clip(weights + np.linalg.solve(gram, slope[:, :, None])[:, :, 0], -8, 8)
        z = mixed_odds()
        p = 1 / (1 + np.exp(-z))
        bin_ = gate * BINS + np.clip(((z + 12) * (BINS / 24)).astype(np.int64), 0, BINS - 1)
        n, came, said = (np.bincount(bin_, v, gates * BINS) for v in (times, hits, times * p))
        table = (came + 2 * np.where(n > 0, said / np.maximum(n, 1), 0.5)) / (n + 2)
        self.chance = ((p + table[bin_]) / 2).reshape(RUN, CELLS)
        self.chance[:, 0] = 0  # nothing is predicted


def text_keys(texts: pa.Array) -> np.ndarray:
    """A min-hash of each text over the bytes that follow the starts of its words; 0 for a text without any."""
    texts = pc.ascii_lower(texts)
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[begins[0] : begins[-1]] if raw is not None else np.empty(0, np.uint8)
    begins = begins - begins[0]
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    start = ~space
    start[1:] &= space[:-1]
    start[begins[:-1][begins[:-1] < len(data)]] |= ~space[begins[:-1][begins[:-1] < len(data)]]
    at = np.flatnonzero(start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    left = begins[1:][np.searchsorted(begins[1:], at, "right")] - at  # bytes up to the end of the text
    found = np.zeros(len(at), np.uint64)
    for half in range(0, WINDOW, 8):
        part = np.zeros(len(at), np.uint64)
        for k in range(half, half + 8):
            part = part << np.uint64(8) | np.where(left > k, padded[at + k], 0).astype(np.uint64)
        found = mixed((found ^ part) * MIX + np.uint64(half + 1))
    out = np.zeros(len(texts), np.uint64)
    if len(at):
        owner = np.searchsorted(begins[1:], at, "right")
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] = np.minimum.reduceat(found, first)
    return out.view(np.int64)


def packed(array: np.ndarray) -> bytes:
    """An array of unsigned numbers, byte by byte of all of them, each such plane compressed by itself."""
    planes = array.view(np.uint8).reshape(len(array), array.dtype.itemsize).T
    return b"".join(len(x).to_bytes(8, "little") + x for x in (pa.compress(p.tobytes(), "zstd", asbytes=True) for p in planes))


def unpacked(data: bytes, count: int, dtype) -> np.ndarray:
    at, size = 0, np.dtype(dtype).itemsize
    out = np.empty((count, size), np.uint8)
    for k in range(size):
        n = int.from_bytes(data[at : at + 8], "little")
        out[:, k] = np.frombuffer(pa.decompress(data[at + 8 : at + 8 + n], count, "zstd"), np.uint8)
        at += 8 + n
    return out.reshape(-1).view(dtype)


class Deal:
    """How the contexts of a corpus, and its tokens beyond the head, are dealt to parts: as many as its text asks for."""

    def __init__(self, text_bytes: int, part_bytes: int = COUNT_BYTES):
        self.parts = min(1 + text_bytes // part_bytes, 1 << 17)
        self.tails, self.hots = 1 + self.parts // 8, 1 + self.parts // 16
        self.counts, self.n, self.docs = None, 1, 0
        self.bits = min(46, 12 + max(1, text_bytes // 4).bit_length())  # so two contexts share their bits with a chance of about 1 in 4000 at most

    def knows(self, mixer: Mixer) -> Deal:
        """With the counts that say which contexts are frequent; only the load of parts depends on them."""
        end = pc.index(mixer.tokens, END).as_py()
        self.counts, self.n, self.docs = mixer.counts.astype(float), max(1, mixer.n), float(mixer.counts[end]) if end >= 0 else 0.0
        return self


class Rows:
    """What a block of texts asks: distinct (two words before, the third, the next token, trained or not) with their number, and its distinct tokens beyond the head."""

    def __init__(self, deal: Deal, head: int, offsets, symbols, codes, distinct, train: np.ndarray):
        own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        self.deal, self.own, self.place, trained = deal, own, np.arange(len(codes)) - offsets[:-1][own], train[own]
        hashes = token_hashes(distinct)
        symbol_of = np.full(len(distinct), head, np.int64)
        symbol_of[codes] = symbols
        tail = symbol_of == head
        names = np.where(tail, head + (hashes % np.uint64((1 << 32) - head)).astype(np.int64), symbol_of)  # of head tokens their own, of others 32 bits
        token, name = hashes[codes], names[codes].astype(np.uint32)

        def back(x, k, none):
            out = np.full(len(x), none, x.dtype)
            out[k:] = x[:-k] if len(x) > k else out[k:]
            out[self.place < k] = none
            return out

        context = mixed(mixed(back(token, 1, 0) + np.uint64(1)) * MIX + back(token, 2, 0) + np.uint64(2)) >> np.uint64(64 - deal.bits)
        third = back(name & np.uint32(0xFFFFFF), 3, 0xFFFFFF)
        hot = np.zeros(len(codes), bool)
        if self.deal.counts is not None:
            count = deal.counts[symbol_of][codes]
            hot = back(count, 1, deal.docs) * back(count, 2, deal.docs) > HOT * deal.n
            hot[self.place == 0] = deal.docs > HOT
        self.hot = np.flatnonzero(hot)
        self.hot_context, self.hot_next, self.hot_trained = context[self.hot], name[self.hot], trained[self.hot]
        context[self.hot] = mixed(self.hot_context * MIX + third[self.hot] + np.uint64(3)) >> np.uint64(64 - deal.bits)  # dealt by three words; what follows two is counted by ``asked_hot``
        key = context << np.uint64(16) | mixed(name.astype(np.uint64) * MIX + third * np.uint64(2) + trained) & np.uint64(0xFFFF)
        order = np.argsort(key, kind="stable")
        key, third, name, trained = key[order], third[order], name[order], trained[order]
        first = np.ones(len(order), bool)
        first[1:] = (key[1:] != key[:-1]) | (third[1:] != third[:-1]) | (name[1:] != name[:-1]) | (trained[1:] != trained[:-1])
        self.row = np.empty(len(order), np.int64)  # of each position
        self.row[order] = np.cumsum(first) - 1
        at = np.flatnonzero(first)
        self.context, self.third, self.next = key[at] >> np.uint64(16), third[at], name[at]
        self.times = (np.diff(np.append(at, len(order))) * trained[at]).astype(np.uint32)
        part = (self.context * np.uint64(deal.parts) >> np.uint64(deal.bits)).astype(np.int64)
        self.ends = np.searchsorted(part, np.arange(deal.parts + 1))

        # tokens beyond the head, by part
        self.codes = np.flatnonzero(tail)
        tail_part = (hashes[self.codes] % np.uint64(deal.tails)).astype(np.int64)
        order = np.argsort(tail_part, kind="stable")
        self.codes = self.codes[order]
        self.tokens = distinct.take(pa.array(self.codes)).cast(pa.large_binary())
        self.counts = np.bincount(codes[train[own]], minlength=len(distinct))[self.codes].astype(np.uint32)
        self.tail_ends = np.searchsorted(tail_part[order], np.arange(deal.tails + 1))

    def asked(self):
        """part, number of rows and their columns, packed, for each part that has some; parts of tokens come after those of contexts."""
        for p in np.flatnonzero(np.diff(self.ends)):
            at = slice(self.ends[p], self.ends[p + 1])
            yield int(p), at.stop - at.start, [packed(np.diff(self.context[at], prepend=np.uint64(0))), packed(self.third[at]), packed(self.next[at]), packed(self.times[at])]
        for p in np.flatnonzero(np.diff(self.tail_ends)):
            at = slice(self.tail_ends[p], self.tail_ends[p + 1])
            tokens = self.tokens[at]
            text = b"".join(tokens.to_pylist())
            lengths = np.asarray(pc.binary_length(tokens)).astype(np.uint32)
            yield self.deal.parts + int(p), len(tokens), [packed(lengths), packed(np.frombuffer(text, np.uint8)), len(text).to_bytes(8, "little"), packed(self.counts[at])]
        yield from self.asked_hot()

    def asked_hot(self):
        """Of frequent contexts what follows them in training, dealt by both to parts after those of tokens; these have no answer of their own."""
        context, token = self.hot_context[self.hot_trained], self.hot_next[self.hot_trained]
        part = (mixed(context * MIX + token) % np.uint64(self.deal.hots)).astype(np.int64)
        order = np.lexsort((token, context, part))
        context, token, part = context[order], token[order], part[order]
        first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (token[1:] != token[:-1]))) if len(order) else order
        times = np.diff(np.append(first, len(order))).astype(np.uint32)
        ends = np.searchsorted(part[first], np.arange(self.deal.hots + 1))
        for p in np.flatnonzero(np.diff(ends)):
            at = slice(ends[p], ends[p + 1])
            yield self.deal.parts + self.deal.tails + int(p), at.stop - at.start, [packed(context[first[at]]), b"", packed(token[first[at]]), packed(times[at])]


def leaders(rows: list[tuple[int, list[bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a part of frequent contexts: context, token, its count and the context's in this part, for the most frequent token; then likewise for the next one, as token 2**32 and without the context's count."""
    context, at = np.unique(np.concatenate([unpacked(x[0], n, np.uint64) for n, x in rows]), return_inverse=True)
    table = Successors(at, *(np.concatenate([unpacked(x[k], n, np.uint32) for n, x in rows]).astype(np.int64) for k in (2, 3)))
    more = np.flatnonzero(table.next)
    context = context.astype(np.int64)
    return np.append(context, context[more]), np.append(table.best, np.full(len(more), 1 << 32)), np.append(table.n, table.next[more]), np.append(table.total, np.zeros(len(more), np.int64))


def answers(deal: Deal, part: int, rows: list[tuple[int, list[bytes]]]) -> list[bytes]:
    """For the rows of one part from all blocks: of each context's row a cell by three and by two words, each training position without itself; of each token its count."""
    sizes = [n for n, _ in rows]
    ends = np.cumsum(sizes)[:-1]
    times = np.concatenate([unpacked(x[3], n, np.uint32) for n, x in rows]).astype(np.int64)
    if part >= deal.parts:
        tokens = []
        for n, x in rows:
            lengths, size = unpacked(x[0], n, np.uint32), int.from_bytes(x[2], "little")
            offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            tokens.append(pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(unpacked(x[1], size, np.uint8))]))
        coded = pa.concat_arrays(tokens).dictionary_encode()
        at = np.asarray(coded.indices)
        return [packed(x.astype(np.uint32)) for x in np.split(np.bincount(at, times)[at], ends)]
    context = np.unique(np.concatenate([np.cumsum(unpacked(x[0], n, np.uint64), dtype=np.uint64) for n, x in rows]), return_inverse=True)[1]
    third = np.concatenate([unpacked(x[1], n, np.uint32) for n, x in rows]).astype(np.int64)
    token = np.concatenate([unpacked(x[2], n, np.uint32) for n, x in rows]).astype(np.int64)
    found = []
    for order in ORDERS:
        table = Successors(context << 24 | third if order == 3 else context, token, times)
        found.append(np.split(cells_of(*table.look(times > 0)), ends))
    return [packed(a) + packed(b) for a, b in zip(*found)]


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode())


def most_frequent(counts: DataFrame, head: int) -> DataFrame:
    """About the ``head`` most frequent tokens; of the class of counts at the border a share by hash, so no task sends more than these."""
    step = F.floor(F.log2(F.col("n").cast("double")) * 256)
    taken, least, grid = 0, None, 1 << 30
    for r in sorted(counts.groupBy(step.alias("s")).agg(F.count("*").alias("k"), F.min("n").alias("low")).collect(), reverse=True):  # a few thousand rows
        if taken + r["k"] > head:
            some = (F.col("n") >= r["low"]) & (F.pmod(F.xxhash64("token"), F.lit(grid)) < grid * (head - taken) // r["k"])
            return counts.filter(some if least is None else some | (F.col("n") >= least))
        taken, least = taken + r["k"], r["low"]
    return counts


def train(docs: DataFrame, counts: DataFrame, head: int = HEAD) -> Mixer | None:
    """docs: training documents (doc_id, text, lang); counts: their token counts. None without any."""
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    if not totals["n"]:
        return None
    top = most_frequent(counts, head).toPandas().sort_values(["n", "token"], ascending=[False, True], ignore_index=True)  # a bounded number of rows; a symbol is a rank by frequency
    langs = [r["lang"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(GROUPS - 1).collect()]
    groups = top["lang"].map({x: k for k, x in enumerate(langs)}).fillna(GROUPS - 1).to_numpy(np.int64)
    tail_n, tail_v = int(totals["n"] - top["n"].sum()), int(totals["v"] - len(top))
    mixer = Mixer(top["token"].tolist(), top["n"].to_numpy(np.int64), groups, tail_n + 1.0, totals["n"], totals["v"], tail_n, tail_v)

    def each(part: pa.RecordBatch) -> pa.RecordBatch:
        _, symbols, contexts, _, _ = mixer.look(strings(part, "text"))
        leaf, kinds, keys, sums = mixer.tree.leaf[symbols], [], [], []
        for kind, (c, size) in enumerate(zip((np.zeros(len(leaf), np.int64), *contexts), (1, *CONTEXTS))):
            found = np.bincount(c * LEAVES + leaf, minlength=size * LEAVES)
            key = np.flatnonzero(found)
            kinds.append(np.full(len(key), kind))
            keys.append(key)
            sums.append(found[key])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (kinds, keys, sums)], ["kind", "key", "n"])

    joint = docs.select("text").mapInArrow(by_slice("text", each, COUNTED), "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).toPandas()  # at most the sizes of the tables
    for kind, size in enumerate((1, *CONTEXTS)):
        own = joint[joint["kind"] == kind]
        table = np.zeros(size * LEAVES)
        table[own["key"].to_numpy()] = own["n"].to_numpy()
        mixer.tables.append(bit_tables(mixer.tree, table.reshape(size, LEAVES)))

    def forms(part: pa.RecordBatch) -> pa.RecordBatch:
        """The slice's log-likelihood about weights that suit it, to second order: for each level a Gram matrix and a vector."""
        _, symbols, contexts, _, _ = mixer.look(strings(part, "text"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in mixer.form(mixer.tree.leaf[symbols], contexts)], ["level", "cell", "value"])

    form = np.zeros((LEVELS, 1 + len(CONTEXTS), 2 + len(CONTEXTS)))
    for r in docs.select("text").mapInArrow(by_slice("text", forms), "level long, cell long, value double").groupBy("level", "cell").agg(F.sum("value").alias("value")).collect():  # a row for each entry of a matrix
        form[r["level"]].ravel()[r["cell"]] = r["value"]
    mixer.weights = np.linalg.solve(form[:, :, :-1] + np.eye(form.shape[1]), form[:, :, -1:] + 0.3)[:, :, 0]
    return mixer


def parts_of(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, text and trained, one partition for each part: by the text's min-hash, and keys with more text than a part (or that many rows) by row number too."""

    def keys(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = strings(part, "text")
        return pa.RecordBatch.from_arrays([pa.array(text_keys(texts)), pc.add(pc.binary_length(texts).cast(pa.int64()), ROW_BYTES)], ["key", "bytes"])

    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    part_bytes = max(part_bytes, total // MOST_PARTS)
    parts = 1 + total // part_bytes
    some = docs.withColumn("rid", F.monotonically_increasing_id()).filter(F.pmod(F.xxhash64("rid"), F.lit(SHARE)) == 0).select("text")  # shares of texts in keys: only sizes of parts depend on them
    sizes = cut(some.mapInArrow(by_slice("text", keys), "key long, bytes long").groupBy("key").agg((SHARE * F.sum("bytes")).alias("bytes")), "part-keys")
    hot = sizes.filter(F.col("bytes") > part_bytes / 2).select("key", F.ceil(2 * F.col("bytes") / part_bytes).alias("pieces"))  # at most twice as many keys as parts

    def with_keys(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(text_keys(strings(part, "text")))], [*part.schema.names, "key"])

    rows = docs.select("doc_id", "text", (~held_out()).alias("trained")).mapInArrow(by_slice("text", with_keys), "doc_id long, text string, trained boolean, key long")
    rows = rows.join(F.broadcast(hot), "key", "left")
    piece = F.pmod(F.monotonically_increasing_id(), F.coalesce("pieces", F.lit(1)))  # rows alike in everything are dealt, too
    return rows.select("doc_id", "text", "trained", F.pmod(F.xxhash64("key", piece), F.lit(parts)).cast("int").alias("part")).repartitionById(parts, "part").drop("part").sortWithinPartitions("doc_id", "trained", F.xxhash64("text"))


UNLIKE = "the documents were read in another order the second time: write them as a table first"
STATES = "doc_id array<long>, trained array<boolean>, bytes array<long>, n_tokens array<long>, known array<long>, base array<double>, plain array<double>, cells binary, tree binary, hits long"


def told(deal: Deal, rows: Rows, said: list[tuple[int, int, bytes]], hot: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """From the answers in the order of parts: of each position the cells of both contexts; the counts of tokens beyond the head. hot: of frequent contexts, ascending, the token, its count, the next count and all."""
    cells, counts = [[], []], [np.empty(0, np.uint32)]
    sizes = np.append(np.diff(rows.ends), np.diff(rows.tail_ends))
    if [(p, n) for p, n, _ in said] != [(p, sizes[p]) for p in np.flatnonzero(sizes)]:
        raise ValueError(UNLIKE)
    for p, n, data in said:
        if p >= deal.parts:
            counts.append(unpacked(data, n, np.uint32))
        else:
            at = 8 + int.from_bytes(data[:8], "little")
            cells[0].append(unpacked(data[:at], n, np.uint8))
            cells[1].append(unpacked(data[at:], n, np.uint8))
    cells = [np.concatenate(x)[rows.row] for x in cells]
    if len(rows.hot):
        at = np.searchsorted(hot[0], rows.hot_context.astype(np.int64))
        at = np.where(hot[0].take(at, mode="clip") == rows.hot_context.astype(np.int64), at, hot.shape[1])  # unseen in training
        _, token, most, after, total = np.pad(hot, ((0, 0), (0, 1)))[:, at]
        cells[ORDERS.index(2)][rows.hot] = cells_of(*foretold(total, most, after, token == rows.hot_next, rows.hot_trained))
    return cells, np.concatenate(counts)


def block_states(mixer: Mixer, deal: Deal, part: pa.RecordBatch, said: list[tuple[int, int, bytes]], hot: np.ndarray) -> pa.RecordBatch:
    """A row for a block: by document what needs no match weights, by position the cells of both contexts, and of each token that one predicts the tree's log10 probability."""
    texts, train = strings(part, "text"), np.asarray(part.column("trained"), dtype=bool)
    offsets, symbols, contexts, codes, distinct = mixer.look(texts)
    rows = Rows(deal, len(mixer.tokens), offsets, symbols, codes, distinct, train)
    n_docs, own, tail = len(texts), rows.own, symbols == len(mixer.tokens)
    cells, counts = told(deal, rows, said, hot)
    count = np.zeros(len(distinct))
    count[rows.codes] = counts
    tree = mixer.tree_scores(offsets, symbols, contexts)
    count = count[codes[tail]]
    tree[tail] += np.log10(count + 1)
    base = mixer.base[symbols]
    base[tail] += np.log10(count + 1)
    known = ~tail
    known[tail] = count > 0
    hit = (cells[0] | cells[1]) & 1 == 1
    by_doc = [np.bincount(own, x, n_docs) for x in (known, base, np.where(hit, 0, tree))]
    small = tree[hit].astype(np.float32)

    def listed(x):
        return pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), x)

    columns = [part.column("doc_id"), pa.array(train), pc.binary_length(texts), pa.array(np.diff(offsets)), pa.array(by_doc[0].astype(np.int64)), pa.array(by_doc[1]), pa.array(by_doc[2])]
    return pa.RecordBatch.from_arrays([*map(listed, columns), pa.array([packed(np.stack(cells, axis=1).reshape(-1).view(np.uint16))]), pa.array([packed(small.view(np.uint32))]), pa.array([len(small)])], [x.split()[0] for x in STATES.split(", ")])


def state_arrays(r: dict):
    """Cells of both contexts, place in the document and document of each position; the tree's values (without them, where they were not read)."""
    n = np.array(r["n_tokens"])
    own = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(own)) - (np.cumsum(n) - n)[own]
    cells = unpacked(r["cells"], len(own), np.uint16).view(np.uint8).reshape(-1, 2).T
    return cells, place, own, unpacked(r["tree"], r["hits"], np.uint32).view(np.float32).astype(float) if "tree" in r else None


def block_scores(bits: list[MatchBit], cells, place, tree) -> np.ndarray:
    """log10 of each token's probability; of tokens that no context predicts without the tree's part."""
    match, rest = np.zeros(len(place)), np.ones(len(place))  # probability = match + rest * tree
    for bit, c in reversed(list(zip(bits, cells))):
        came = c & 1
        p = bit.chance[runs_of(came == 1, place), c >> 1]
        match, rest = (1 - p) * match + p * came, (1 - p) * rest
    hit = match > 0
    out = np.log10(rest)
    out[hit] = np.log10(match[hit] + rest[hit] * 10**tree)
    return out


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    seen = docs.filter(~held_out()).select("doc_id", "text", "lang")
    counts = cut(token_counts(seen), "token-counts")
    mixer = train(seen, counts, head)
    if mixer is None:
        tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")) + 1
        zero, none = F.lit(0.0), F.lit(0).cast("long")
        return docs.select("doc_id", held_out().alias("held_out"), tokens.cast("long").alias("n_tokens"), none.alias("n_known"), none.alias("train_tokens"), zero.alias("base_score"), zero.alias("score"), zero.alias("bits_per_byte"))

    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES)).first()[0]
    deal = Deal(total).knows(mixer)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (~held_out()).alias("trained"))

    def blocks(batches):
        """Block number (the same at each reading: by partition, then in order), and its rows."""
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_slices(batch, "text", BLOCK_BYTES):
                yield n, part
                n += 1

    def ask(batches):
        for n, part in blocks(batches):
            asked = Rows(deal, len(mixer.tokens), *mixer.tokens_in(strings(part, "text")), np.asarray(part.column("trained"), dtype=bool)).asked()
            for some in iter(lambda: list(islice(asked, 256)), []):
                parts, sizes, columns = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([n] * len(parts)), pa.array(sizes), *(pa.array(c, pa.binary()) for c in zip(*columns))], ["part", "block", "size", "a", "b", "c", "d"])

    names = ["block", "part", "size", "data", "context", "next", "total"]

    def answer(batches):
        found = [r for batch in batches for r in batch.to_pylist()]  # of one part
        if not found:
            return
        part, asked = found[0]["part"], [(r["size"], [r[c] for c in "abcd"]) for r in found]
        found = [(r["block"], r["size"]) for r in found]
        if part >= deal.parts + deal.tails:
            context, token, n, total = leaders(asked)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(n), pa.nulls(len(n), pa.binary()), *map(pa.array, (context, token, total))], names)
            return
        said = answers(deal, part, asked)
        for a in range(0, len(found), 256):
            block, size = zip(*found[a : a + 256])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array([part] * len(block), pa.int32()), pa.array(size), pa.array(said[a : a + 256], pa.binary()), *[pa.nulls(len(block), pa.int64())] * 3], names)

    def keep(batches):
        for n, part in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "data"])

    def meet(kept: pa.Table, said: pa.Table) -> pa.Table:
        if kept.num_rows != 1:
            raise ValueError(UNLIKE)
        part = pa.ipc.open_stream(kept.column("data")[0].as_py()).read_next_batch()
        found = sorted((r["part"], r["size"], r["data"]) for r in said.select(["part", "size", "data"]).to_pylist())
        return pa.Table.from_batches([block_states(mixer, deal, part, found, hot)])

    asked = rows.mapInArrow(ask, "part int, block long, size long, a binary, b binary, c binary, d binary").repartitionById(deal.parts + deal.tails + deal.hots, "part")
    answered = cut(asked.mapInArrow(answer, "block long, part int, size long, data binary, context long, next long, total long"), "answers")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("n"), "next"))), 1, 2)  # two of a part each
    leading = answered.filter("context is not null").groupBy("context").agg(best.alias("best"), F.sum("total").alias("total")).collect()  # one in HOT positions at most, by expectation
    hot = np.array(sorted((r["context"], r["best"][0]["next"], -r["best"][0]["n"], -r["best"][1]["n"] if len(r["best"]) > 1 else 0, r["total"]) for r in leading), np.int64).reshape(-1, 5).T
    said = answered.filter("context is null").select("block", "part", "size", "data")
    kept = rows.mapInArrow(keep, "block long, data binary")
    states = cut(kept.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(meet, STATES), "states")

    def tally(batches):
        total = np.zeros((len(ORDERS), RUN * CELLS * 2), np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                cells, place, own, _ = state_arrays(r)
                train = np.array(r["trained"])[own]
                for k, c in enumerate(cells):
                    use = np.flatnonzero(train & (c > 0))
                    total[k] += np.bincount(runs_of(c & 1 == 1, place)[use] * (2 * CELLS) + c[use], minlength=total.shape[1])
        kind, key = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(total[kind, key])], ["kind", "key", "n"])

    seen_cells = np.zeros((len(ORDERS), RUN * CELLS * 2), np.int64)
    for r in states.select("trained", "n_tokens", "cells").mapInArrow(tally, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect():  # a model's size
        seen_cells[r["kind"], r["key"]] = r["n"]
    bits = [MatchBit(x) for x in seen_cells]

    def finish(batches):
        for batch in batches:
            for r in batch.to_pylist():
                cells, place, own, tree = state_arrays(r)
                value = block_scores(bits, cells, place, tree)
                score = np.bincount(own, value, len(r["n_tokens"])) + np.array(r["plain"])
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"], pa.int64()), *(pa.array(r[c], pa.int64()) for c in ("n_tokens", "known", "bytes")), pa.array(r["base"], pa.float64()), pa.array(score)], ["doc_id", "n_tokens", "n_known", "bytes", "base_score", "score"])

    scored = states.mapInArrow(finish, "doc_id long, n_tokens long, n_known long, bytes long, base_score double, score double")
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(int(mixer.n)).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        (-F.col("score") * math.log2(10) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
